"""Streams that keep state or versions: restarts, late rows, batches that run twice."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.versions import Versions
from tessera.streaming import jobs as S

HISTORY = "key string, ts timestamp, id long, note string"
PARTS = {"projects": "local_path string, id string, name string, score long, updated_at timestamp", "inventory": "local_path string, path string, size_bytes long"}
SCAN = "local_path string, name string, score long, scanned_at timestamp, files array<struct<path:string,size_bytes:long>>"


def drop(spark, path, name, rows, schema):
    """One more file for a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_reuse_with_restarts_and_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pick = random.Random(2)
    schema, src, out = "key string, ts timestamp, id long", str(tmp_path / "in"), str(tmp_path / "out")
    # each file holds times that overlap the one before by less than half an hour, in no order; b is forgotten for a day
    rows, number = [], 0
    for part in range(3):
        own = []
        for _ in range(60):
            number += 1
            own.append((pick.choice("abcdefghijklmnopqrstuvwxyz") if part != 1 else pick.choice("abcd"), at(part * 40 + pick.uniform(0, 25) if part < 2 else 1600 + pick.uniform(0, 60)), number))
        rows.append(own)
    rows.append([("end", at(100_000), 0)])
    for k, own in enumerate(rows):
        drop(spark, src, f"p{k}", own, schema)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        S.run_available(S.reuse_stream(stream, 20 * 60, 12 * 3600), out, str(tmp_path / "ck"))
    batch = spark.createDataFrame([r for own in rows for r in own], schema)
    want = S.reuse(batch.filter("key <> 'end'"), 20 * 60, 12 * 3600)
    key = lambda df: sorted((r.key, r.ts, str(r.id), r.reason, r.hit) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want)
    assert {r.reason for r in want.collect()} == {"absent", "expired", "fresh"} and want.filter("reason = 'absent'").count() > 3


def test_histories_are_kept_by_the_stream(spark, tmp_path):
    src, pick = str(tmp_path / "in"), random.Random(3)
    rows = [[(pick.choice(["a", "b", None]), at(pick.randrange(500)), pick.randrange(200), "x") for _ in range(80)] for _ in range(3)]
    table = Versions(spark, str(tmp_path / "t"), {"history": HISTORY}, "key", 4)
    for k, own in enumerate(rows):
        drop(spark, src, f"p{k}", own, HISTORY)
        stream = spark.readStream.schema(HISTORY).option("recursiveFileLookup", "true").parquet(src)
        S.histories(stream, table, str(tmp_path / "ck"), 10)
    newest = {}
    for k, t, i, _ in [r for own in rows for r in own]:
        newest[(k, i)] = max(t, newest.get((k, i), t))
    want = {k: sorted(((t, i) for (kk, i), t in newest.items() if kk == k), reverse=True)[:10] for k in ("a", "b", None)}
    got = {}
    for r in table.read("history").collect():
        got.setdefault(r.key, []).append((r.ts, r.id))
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == want and table.version() == 2
    # a new checkpoint brings all rows again, as batch 0, whose marker stands
    S.histories(spark.readStream.schema(HISTORY).option("recursiveFileLookup", "true").parquet(src), table, str(tmp_path / "ck2"), 10)
    assert table.version() == 2 and table.read("history").count() == 30


def test_rescans_upsert_projects_and_replace_inventories(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), PARTS, "local_path", 8)
    src = str(tmp_path / "in")
    scans = [
        [("/a", "A", 1, at(0), [("x.ts", 1), ("y.ts", 2)]), ("/b", "B", 2, at(0), []), ("/a", "A2", 3, at(5), [("x.ts", 9)])],
        [("/b", "B2", 5, at(9), [("z.ts", 3)]), ("/c", "C", 7, at(9), None), (None, "lost", 0, at(9), [])],
    ]
    for k, own in enumerate(scans):
        drop(spark, src, f"p{k}", own, SCAN)
        S.rescans(spark.readStream.schema(SCAN).option("recursiveFileLookup", "true").parquet(src), table, str(tmp_path / "ck"))
        if k == 0:
            first = {r.local_path: r.id for r in table.read("projects").collect()}
    projects = {r.local_path: (r.name, r.score, r.updated_at) for r in table.read("projects").collect()}
    assert projects == {"/a": ("A2", 3, at(5)), "/b": ("B2", 5, at(9)), "/c": ("C", 7, at(9))}
    assert {r.local_path: r.id for r in table.read("projects").collect()}.items() >= first.items()
    assert sorted(map(tuple, table.read("inventory").collect())) == [("/a", "x.ts", 9), ("/b", "z.ts", 3)]


def test_a_version_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), {"one": "k long, v long", "two": "k long, v long"}, "k", 4)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v long")
    put = lambda old, batch: {p: old[p].join(batch, "k", "left_anti").unionByName(batch) for p in ("one", "two")}
    assert table.version() is None and table.read("one").count() == 0
    assert table.apply(0, rows((1, 1), (2, 1)), put) and not table.apply(0, rows((1, 5)), put)

    def fails(old, batch):
        made = put(old, batch)
        return {"one": made["one"], "two": made["two"].withColumn("v", F.raise_error(F.lit("lost")).cast("long"))}

    with pytest.raises(Exception, match="lost"):
        table.apply(1, rows((1, 2), (3, 2)), fails)
    both = lambda: [sorted(map(tuple, table.read(p).collect())) for p in ("one", "two")]
    assert table.version() == 0 and both() == [[(1, 1), (2, 1)]] * 2
    assert table.apply(1, rows((1, 2), (3, 2)), put) and both() == [[(1, 2), (2, 1), (3, 2)]] * 2
    assert table.apply(2, rows(), put) and table.apply(3, rows((2, 7), (1, 9), (3, 9)), put)
    assert table.clean(1) == [0, 1, 2] and table.clean(1) == []
    assert both() == [[(1, 9), (2, 7), (3, 9)]] * 2
