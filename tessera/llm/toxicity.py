"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features: 2 ** BITS.
BITS = 20
#: Words whose hashes a worker remembers.
CACHE = 500_000
_STRIP = b".,;:!?\"'()[]{}|#*$%&<>-_"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Params:
    """Training parameters. ``sample`` bounds the labelled rows that are fitted on."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 4
    sample: int = 12_000
    seed: int = 11


@dataclass
class Model:
    """Sparse weights: the features that L1 left, in ascending order, and their weights; and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    dense: np.ndarray | None = field(default=None, repr=False)

    def table(self) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS, np.float64)
            self.dense[self.index] = self.weight
        return self.dense

    def score(self, features: np.ndarray) -> float:
        w = self.table()[features]
        hit = np.unique(features[w != 0])
        z = self.bias + float(self.table()[hit].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        plain = word.strip(_STRIP) or word
        self[word] = got = xxhash.xxh64_intdigest(plain)
        return got


class Featurizer:
    """Feature numbers of a text: words, pairs of neighbours, and pairs with one or two words between (skip-grams)."""

    def __init__(self):
        self.hash = _WordHash().__getitem__

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace").lower().encode().split()
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        top = np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            parts = [(h * _MIX[0]) >> top]
            for gap in (1, 2, 3):
                if len(h) > gap:
                    parts.append(((h[:-gap] * _MIX[gap]) + (h[gap:] * _MIX[0] ^ (h[gap:] >> np.uint64(31)))) * _MIX[1] >> top)
        return np.concatenate(parts).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]], p: Params) -> Model:
    """FTRL-proximal over rows of (distinct features, label), in a seeded order that is new for each epoch."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(zx, nx, l1):
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((p.beta + np.sqrt(nx)) / p.alpha + p.l2))

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)).tolist():
            x, y = rows[k]
            x = np.append(x, bias)
            l1 = np.append(np.full(len(x) - 1, p.l1), 0.0)
            nx = n[x]
            w = weights(z[x], nx, l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / p.alpha * w
            n[x] += g * g
    w = weights(z, n, np.append(np.full(bias, p.l1), 0.0))
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept], float(w[-1]) if rows else -35.0)


def fold(column: str, parts: int) -> Column:
    """crc32 of a column as text, modulo ``parts``; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one row for each doc_id whose labels that are 0 or 1 agree."""
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    return (
        known.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("other")).filter("y = other").select("doc_id", F.col("y").cast("int").alias("y"))
    )


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on at most ``p.sample`` labelled rows of ``docs(doc_id, text)``: those whose hashed doc_id is lowest.

    FTRL is sequential, so the bounded sample is fitted in one task; what returns are the weights that L1 left.
    Repeated doc_ids count once. With no labelled row the model scores everything 0.
    """
    known = docs.select("doc_id", "text").join(labelled(labels, "toxic"), "doc_id")
    order = F.xxhash64(F.lit(p.seed), "doc_id")
    chosen = labelled(labels, "toxic").join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(p.sample).select("doc_id")
    sample = known.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        features = Featurizer()
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable").tolist()
        texts, y = table.column("text"), table.column("y").to_pylist()
        model = fit([(np.unique(features((texts[k].as_py() or "").encode())), y[k]) for k in order], p)
        return pa.table({"i": pa.array(np.append(model.index, -1)), "w": pa.array(np.append(model.weight, model.bias))})

    got = sample.withColumn("fold", F.lit(0)).groupBy("fold").applyInArrow(run, "i long, w double").toArrow()
    if not got.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -35.0)
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()  # the bias's index is -1
    order = np.argsort(i)
    i, w = i[order], w[order]
    return Model(i[1:], w[1:], float(w[0]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score double, predicted int) for every row of ``docs(doc_id, text)``; null texts count as empty.

    The weights travel in one broadcast: 2 ** BITS entries at most, a few thousand as a rule. Null doc_ids and
    repeated rows stay; extra columns are ignored; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = Model(*shared.value), Featurizer()
        for batch in batches:
            got = [own.score(features(t.as_py() or b"")) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
