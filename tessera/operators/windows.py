"""Ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the one with the largest ``tie``."""
    order = Window.partitionBy(key).orderBy(F.desc(when), F.desc(tie))
    return rows.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")


def top_k_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def best_with_margin(rows: DataFrame, key: str, score: str, tie: str, margin: float) -> DataFrame:
    """The best row of each key, if it leads the next by ``margin`` or stands alone."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("__at", F.row_number().over(order)).withColumn("__next", F.lead(score).over(order))
    return ranked.filter((F.col("__at") == 1) & (F.col("__next").isNull() | (F.col(score) - F.col("__next") >= margin))).drop("__at", "__next")


def relative_threshold(rows: DataFrame, key: str, score: str, ratio: float, floor: float) -> DataFrame:
    """Rows whose score is at least ``floor`` and at least ``ratio`` of their key's best."""
    top = F.max(score).over(Window.partitionBy(key))
    return rows.withColumn("__top", top).filter(F.col(score) >= F.greatest(F.lit(floor), F.col("__top") * ratio)).drop("__top")


def first_by_key(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key, by position."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")


def stratified_window(rows: DataFrame, key: str, strata: dict[str, tuple[Column, int]], order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each key: each stratum's reserve first, in the strata's order, then the best others.

    ``strata``: name to (membership, reserve). A row that a stratum admits does not use up a later one's reserve.
    """
    best = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("__best", F.row_number().over(best)).withColumn("stratum", F.lit(None).cast("string")).withColumn("__level", F.lit(len(strata)))
    for level, (name, (member, reserve)) in enumerate(strata.items()):
        own = member & F.col("stratum").isNull()
        place = F.sum(F.when(own, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("__best").rowsBetween(Window.unboundedPreceding, 0))
        admitted = own & (place <= reserve)
        out = out.withColumn("__in", admitted).withColumn("stratum", F.when(F.col("__in"), name).otherwise(F.col("stratum")))
        out = out.withColumn("__level", F.when(F.col("__in"), level).otherwise(F.col("__level"))).drop("__in")
    placed = out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("__level", "__best")))
    return placed.filter(F.col("rank") <= limit).withColumn("stratum", F.coalesce("stratum", F.lit("fill"))).drop("__best", "__level")
