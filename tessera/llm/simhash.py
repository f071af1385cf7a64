"""SimHash near-duplicate detection with Burkhard-Keller trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bktree import Forest, block_masks, signed
from .common import join_hot, materialize, text_of
from .components import connected_components

SEED = 42
SHINGLE = 4
RADIUS = 4
MASKS = block_masks(RADIUS)
_STEP = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is 1 where over half the unsigned 64-bit hashes have it set; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text over its ``width``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th long, fp long) for every row: the text's hash and fingerprint; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = pa.array([signed(fingerprint(x.as_py() or b"")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fps], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64(text_of()).alias("th")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def shards(items: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once for each mask, as column t, dealt out so that a shard's rows meet in one task."""
    mask = F.element_at(F.array(*[F.lit(signed(m)) for m in masks]), F.col("t") + 1)
    dealt = items.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
    return dealt.repartition("t", F.col("fp").bitwiseAND(mask))


def shard_of(t: np.ndarray, fp: np.ndarray, masks: list[int]) -> np.ndarray:
    """A number that is equal for rows of one shard only, within a task."""
    pair = np.empty(len(t), [("t", np.int64), ("key", np.uint64)])
    pair["t"], pair["key"] = t, fp & np.array(masks, np.uint64)[t]
    order = np.lexsort((pair["key"], pair["t"]))
    out = np.empty(len(t), np.int64)
    if len(t):
        ranked = pair[order]
        out[order] = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct ``fp`` linked at ``RADIUS`` bits or less; a spanning forest for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("t").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not got:
            return
        t, fp = (np.concatenate(x) for x in zip(*got))
        raw = fp.view(np.uint64)
        i, j = Forest(shard_of(t, raw, MASKS), raw).links(RADIUS, np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    return shards(distinct.select("fp"), MASKS).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text, ...)``: (doc_id, fp, component_id), one row for each input row.

    Fingerprints are SimHashes over 4-word shingles of the ASCII-lower-cased text; two are linked at 4 or fewer
    differing bits, and a class is all that links reach. Equal fingerprints are one node, so a large group of copies
    is one row in the search. Null and empty texts have fingerprint zero and are linked like any other. Rows with a
    null doc_id get a class too; component_id is the smallest doc_id of the class that is not null (null if none).
    Repeated rows stay repeated; extra columns are ignored; an empty table gives an empty result.

    Trees are not broadcast: all of them together are as large as the corpus. Each shard's tree is built in the task
    that holds the shard, and every fingerprint visits the shards that could hold a partner.
    """
    return classified(docs).select("doc_id", "fp", "component_id")


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, component, component_id) of every row; component: a fingerprint that names its class.

    Classes and fingerprints that hold many rows are joined apart, so that no task gathers them.
    """
    fps = materialize(fingerprints(docs), "simhash-fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    member = connected_components(links(distinct)).select(F.col("node").alias("fp"), "component")
    member = materialize(distinct.join(member, "fp"), "simhash-member")
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m"))
    linked = join_hot(member, materialize(least, "simhash-least"), "component", "m").select("fp", "n", "component", "component_id")
    alone = distinct.join(member, "fp", "left_anti").select("fp", "n", F.col("fp").alias("component"), F.col("first_id").alias("component_id"))
    classes = materialize(linked.unionByName(alone), "simhash-classes")
    return join_hot(fps, classes, "fp", "n").select("doc_id", "th", "fp", "component", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class: that with the smallest doc_id, nulls last, then text hash.

    Rows are told apart by doc_id and text, so a doc_id that repeats with different texts loses only what is in
    another row's class. Of rows that repeat both, the one whose columns hash lowest stays. A null text counts as
    empty, and all empty texts are one class. Columns stay as they are, also those of names used here; an empty table
    gives an empty result.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("hash"))
    rows = classified(docs).groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min_by(F.struct(F.col("doc_id").alias("__id"), F.col("th").alias("__hash"), F.col("n").alias("__n")), place).alias("best"))
    best = materialize(best.select("best.*"), "simhash-best")
    keyed = docs.withColumn("__th", F.xxhash64(text_of()))
    same = keyed["doc_id"].eqNullSafe(best["__id"]) & (keyed["__th"] == best["__hash"])
    kept = keyed.join(best, same)
    if best.filter("__n > 1").isEmpty():
        return kept.select(*docs.columns)
    spot = Window.partitionBy("__id", "__th").orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("__at", F.row_number().over(spot)).filter("__at = 1").select(*docs.columns)
