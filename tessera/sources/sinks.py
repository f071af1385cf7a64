"""Upserts, patches, deletions and bounded histories: each gives the table's next version as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, fresh: DataFrame, key: str, keep: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """``current`` with the rows of ``fresh`` put in by ``key``: columns ``keep`` stay as they were, the rest is replaced.

    Both have the same columns. Rows that only ``current`` has stay untouched.
    """
    a, b = current.alias("a"), fresh.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    is_new = F.col(f"b.{key}").isNotNull()
    cols = []
    for c in current.columns:
        if c == key or c in keep:
            value = F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        elif c == stamp:
            value = F.when(is_new, now).otherwise(F.col(f"a.{c}"))
        else:
            value = F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        cols.append(value.alias(c))
    return joined.select(*cols)


def patch(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``patches`` put in where they are not null."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in patches.columns if c != key])
    joined = rows.join(p, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in patches.columns and c != key else F.col(c) for c in rows.columns])


def upsert_kv(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, value, updated_at): the newest value of each key."""
    both = current.unionByName(fresh)
    return both.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at"))


def delete_rows(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows without those of ``keys``, and ``keys`` with whether a row existed."""
    found = rows.select(*on).distinct().withColumn("existed", F.lit(True))
    return rows.join(keys, on, "left_anti"), keys.join(found, on, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def keep_last(rows: DataFrame, key: str, when: str, tie: str, n: int = 50) -> DataFrame:
    """The newest n rows of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(when), F.desc(tie))
    return rows.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= n).drop("__at")
