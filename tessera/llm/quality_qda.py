"""Document quality by regularised quadratic discriminant analysis over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .toxicity import labelled

NAMES = (
    "log_words", "word_bytes", "symbols", "uppers", "bangs", "stops", "commas", "bars", "short_words", "distinct_words", "repeated_triples", "line_words", "digits",
)
_SYMBOLS = b"#*$%&<>"
_ALL = bytes(range(256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _share(part: int, whole: int) -> float:
    """A share on a log scale that is finite at none and at all."""
    return float(np.log((part + 0.5) / (whole + 1.0)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole UTF-8 text, in the order of ``NAMES``."""
    words = text.split()
    n = len(words)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    triples = list(zip(words, words[1:], words[2:]))
    upper_words = text.split(b"\n")
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / max(n, 1))),
        _share(count(_SYMBOLS), n),
        _share(count(_UPPER), len(text)),
        _share(text.count(b"!"), n),
        _share(text.count(b".") + text.count(b"?"), n),
        _share(text.count(b","), n),
        _share(text.count(b"|"), n),
        _share(sum(len(w) <= 3 for w in words), n),
        float(np.log((len(set(words)) + 1) / (n + 1))),
        _share(len(triples) - len(set(triples)), len(triples)),
        float(np.log1p(n / max(len(upper_words), 1))),
        _share(count(_DIGITS), n),
    ]


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., x array<double>) for every row; a null text counts as empty."""
    read = docs.select("doc_id", "text", *carry)
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in names)
    return read.mapInArrow(run, f"{kinds}, x array<double>")


@dataclass
class Model:
    """For each class: mean, inverse Cholesky factor of its shrunk covariance, and log prior minus half its log determinant."""

    mean: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray
    scale: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row, from the difference of the log densities."""
        z = np.einsum("cij,ncj->nci", self.inverse, x[:, None, :] - self.mean[None])
        log = self.offset[None] - 0.5 * (z**2).sum(axis=2)
        return 1 / (1 + np.exp(-np.clip((log[:, 1] - log[:, 0]) * self.scale, -35, 35)))


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Model | None:
    """Fit on all of ``rows(x array<double>, y int)``: one pass of sums of x and its products, no sample.

    A class's covariance is shrunk by ``shrink`` towards the pooled one and its diagonal, and gets ``ridge`` on the
    diagonal. Null if a class has no row.
    """
    d = len(NAMES)
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    sums = rows.groupBy("y").agg(
        F.count("*").alias("n"),
        *[F.sum(F.get("x", F.lit(a))).alias(f"s{a}") for a in range(d)],
        *[F.sum(F.get("x", F.lit(a)) * F.get("x", F.lit(b))).alias(f"p{a}_{b}") for a, b in pairs],
    )
    got = {r.y: r for r in sums.collect()}  # two rows
    if set(got) != {0, 1}:
        return None
    n = np.array([got[y].n for y in (0, 1)], float)
    mean = np.array([[got[y][f"s{a}"] for a in range(d)] for y in (0, 1)]) / n[:, None]
    second = np.zeros((2, d, d))
    for y in (0, 1):
        for a, b in pairs:
            second[y, a, b] = second[y, b, a] = got[y][f"p{a}_{b}"]
    cov = second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    inverse, offset = [], []
    for y in (0, 1):
        weight = shrink + (1 - shrink) * d / (d + n[y])  # few rows lean on the pooled covariance
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
        shrunk = (1 - weight) * cov[y] + weight * target + ridge * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        offset.append(np.log(n[y] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(mean, np.array(inverse), np.array(offset))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on every row of ``docs(doc_id, text)`` whose ``labels(doc_id, quality)`` agree on 0 or 1.

    Labels meet the statistics, so that no text is shuffled.
    """
    return fit(features(docs).join(labelled(labels, "quality"), "doc_id").select("x", "y"))


def apply(stats: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``stats(..., x)`` with ``score double`` and ``predicted int`` in place of x. Without a model every score is 1."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            got = own.scores(x) if own is not None else np.ones(batch.num_rows)
            rest = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(got, pa.float64())], names=[*rest, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "x")
    return stats.mapInArrow(run, f"{kinds}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, by a model fitted on its labelled rows.

    ``held_out``: a column that is true for the doc_ids whose labels must not be used. Statistics are computed once
    for each text and serve both fitting and scoring. Null texts count as empty; null doc_ids and repeated rows stay;
    extra columns are ignored.
    """
    stats = materialize(features(docs), "quality-stats")
    known = labelled(labels if held_out is None else labels.filter(~held_out), "quality")
    model = fit(stats.join(known, "doc_id").select("x", "y"))
    return apply(stats, model)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject (score ``threshold`` or more), columns as they are.

    Statistics and score are found in one step, so that a task has one Python worker and a text goes to it once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own is None or not batch.num_rows:
                yield batch
                continue
            x = np.array([statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())])
            yield batch.filter(pa.array(own.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
