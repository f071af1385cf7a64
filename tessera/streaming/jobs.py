"""Structured Streaming jobs and the batch forms they agree with once all data has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import cut
from ..sources.sinks import keep_last
from ..sources.versions import Versions

LATE = "30 minutes"


def sessions(trace: DataFrame, gap: str = LATE) -> DataFrame:
    """Sessions of ``(session_id, ts, kind, duration)``: they end after ``gap`` without a record; batch or stream."""
    rows = trace.withWatermark("ts", LATE) if trace.isStreaming else trace
    grouped = rows.groupBy("session_id", F.session_window("ts", gap).alias("w"))
    found = grouped.agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "miss").alias("misses"))
    return found.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records", "hits", "misses")


def audit_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; batch or stream."""
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n")


def inbox(deliveries: DataFrame) -> DataFrame:
    """Deliveries without repeats of ``(delivery_id, content_hash)``, their status mapped to a fixed set."""
    status = F.when(F.col("status").isin("ok", "done", "success"), "delivered").when(F.col("status").isin("error", "failed"), "failed").otherwise("pending")
    rows = deliveries.withColumn("status", status)
    if rows.isStreaming:
        return rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["delivery_id", "content_hash"])
    return rows.dropDuplicates(["delivery_id", "content_hash"])


def reuse(requests: DataFrame, ttl_seconds: int, memory_seconds: int | None = None) -> DataFrame:
    """For each of ``(key, ts, id)`` whether its key was asked for within the time to live before; batch.

    After ``memory_seconds`` a key is absent again, as it is to a stream that forgets it.
    """
    order = Window.partitionBy("key").orderBy("ts", "id")
    before = F.lag("ts").over(order)
    age = F.unix_micros("ts") - F.unix_micros(before)
    gone = before.isNull() if memory_seconds is None else before.isNull() | (age > memory_seconds * 1_000_000)
    reason = F.when(gone, "absent").when(age > ttl_seconds * 1_000_000, "expired").otherwise("fresh")
    return requests.withColumn("reason", reason).withColumn("hit", F.col("reason") == "fresh")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that a stream has to offer as Parquet, and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def for_each_version(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``apply`` on each batch: the incremental rescan and the bounded history write the table's next version in it."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "miss").when(F.col("event_type") == "view", "hit").otherwise("stage")
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", kind.alias("kind"), F.col("value").alias("duration"))


def rescans(stream: DataFrame, table: Versions, checkpoint: str) -> StreamingQuery:
    """Incremental rescan: each batch of ``(local_path, name, score, scanned_at, files)`` becomes a version of a table.

    ``table`` has the parts projects (local_path, id, name, score, updated_at) and inventory (local_path, path,
    size_bytes), by local_path. Of several scans of one project in a batch the last counts. A known project keeps its id
    and takes the rest from the scan; a new one gets an id by a hash of its path. The files of a scanned project replace
    those it had. Projects that are not scanned stay. Batches that run again change nothing.
    """

    def change(old: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        last = batch.filter("local_path IS NOT NULL").groupBy("local_path").agg(F.max_by(F.struct("name", "score", "scanned_at", "files"), F.struct("scanned_at", "name")).alias("s"))
        last = cut(last.select("local_path", "s.*"))
        known = old["projects"].alias("o").join(last.alias("n"), "local_path", "full")
        new_id = F.concat(F.lit("project_"), F.left(F.sha2("local_path", 256), F.lit(14)))
        projects = known.select(
            "local_path", F.coalesce("o.id", new_id).alias("id"), F.when(F.col("n.scanned_at").isNull(), F.col("o.name")).otherwise(F.col("n.name")).alias("name"),
            F.when(F.col("n.scanned_at").isNull(), F.col("o.score")).otherwise(F.col("n.score")).alias("score"), F.coalesce("n.scanned_at", "o.updated_at").alias("updated_at"),
        )
        files = last.select("local_path", F.explode("files").alias("f")).select("local_path", "f.path", "f.size_bytes")
        return {"projects": projects, "inventory": old["inventory"].join(last, "local_path", "left_anti").unionByName(files)}

    return for_each_version(stream, checkpoint, lambda batch, number: table.apply(number, batch, change))


def histories(stream: DataFrame, table: Versions, checkpoint: str, n: int = 50) -> StreamingQuery:
    """Rolling history: the newest ``n`` rows ``(key, ts, id, ...)`` of each key, kept in the part history of ``table``.

    Ties go to the larger id. A row that comes again under the same key and id counts once, so that a source that
    repeats rows does not push others out.
    """
    columns = stream.columns

    def change(old: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        both = old["history"].select(columns).unionByName(batch.select(columns))
        one = both.groupBy("key", "id").agg(F.max(F.struct("ts", *[c for c in columns if c not in ("key", "ts", "id")])).alias("r")).select("key", "id", "r.*")
        return {"history": keep_last(one, "key", "ts", "id", n).select(columns)}

    return for_each_version(stream, checkpoint, lambda batch, number: table.apply(number, batch, change))


def reuse_stream(requests: DataFrame, ttl_seconds: int, memory_seconds: int = 30 * 86_400, late: str = LATE) -> DataFrame:
    """``reuse`` of a stream (key, ts, id): (key, ts, id, reason, hit), rows in any order within ``late`` of the newest.

    A key's state is when it was asked for last, and the requests that the watermark has not passed yet: these are
    answered in the order of time when it does, so a late row is answered as if it had come in time. Rows behind the
    watermark are left out, and keys unasked for ``memory_seconds`` are forgotten, both by timers. The state is in the
    checkpoint; the session needs the RocksDB state store.
    """
    from .state import Reuse

    # times also as numbers, which mean the same in every time zone
    read = requests.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("micros"), F.col("id").cast("string").alias("id")).withWatermark("ts", late)
    found = read.groupBy("key").transformWithStateInPandas(
        Reuse(ttl_seconds * 1_000_000, memory_seconds * 1_000_000), outputStructType="key string, micros long, id string, reason string, hit boolean", outputMode="Append", timeMode="EventTime"
    )
    return found.select("key", F.timestamp_micros("micros").alias("ts"), "id", "reason", "hit")
