"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, quality_qda, queries, simhash
from tessera.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; null and repeated doc_ids are judged row by row. All columns stay.
    An empty table gives an empty result; without labels of both kinds there is no classifier and all rows stay.
    """
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that loses its last word with them.

    Documents that had no word before, null texts among them, stay. n_chars is counted anew where lines went. Rows
    that repeat both doc_id and text get the same text. Extra columns stay as they are.
    """
    # input columns that have the names of the operator's counts come back under their own names
    clash = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(clash))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = out.filter(~emptied).withColumn("n_chars", chars)
    return out.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the smallest doc_id, nulls last.

    Empty and null texts are one class. Rows are told apart by doc_id and text; of equal rows one stays. All columns stay.
    """
    return simhash.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as it is taken.

    Null languages and sources are leaves of their own. A document without words weighs nothing: it is taken with
    whole epochs and wherever the prefix passes it. Repeated rows are taken one by one. All columns stay.
    """
    clash = {c: f"__own_{c}" for c in ("mix_domain", "mix_epoch", "mix_tokens") if c in docs.columns}
    mixed = mixing.mix_sources(docs.withColumnsRenamed(clash))
    return mixed.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: token ids, and what they decode to.

    A null text counts as empty: no ids. Null and repeated doc_ids stay; other columns are not returned.
    """
    return bpe.encode_digests(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: SQL has no SimHash, classifier or BPE: the tests hold the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
