"""Sealed sets of cases and projects: digests by bucket, what differs, and migration.

A lock is two tables: items with a digest each, and buckets with one digest of their items. Whether a set is as it was
takes the buckets alone; what changed takes only the items of the buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items(cases: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """(scope, name, bucket, item, digest) of ``cases(split, case_id, columns)`` and ``files(project_id, path, content)``.

    scope is cases or project, name the split or project. Null values have a digest of their own. Of rows that share an
    item the digests count together, in order, so repeated rows are told from single ones.
    """
    shown = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    one = lambda scope, name, item, value: (F.lit(scope).alias("scope"), F.col(name).cast("string").alias("name"), F.col(item).cast("string").alias("item"), F.sha2(value, 256).alias("digest"))
    both = cases.select(*one("cases", "split", "case_id", F.concat_ws("\n", *[shown(c) for c in columns]))).unionByName(files.select(*one("project", "project_id", "path", shown("content"))))
    named = both.select("scope", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("item", F.lit("")).alias("item"), "digest")
    # repeats of one row are counted before they meet, so that no group grows with its copies
    counted = named.groupBy("scope", "name", "item", "digest").agg(F.count("*").alias("n"))
    each = counted.groupBy("scope", "name", "item").agg(F.array_sort(F.collect_list(F.concat("digest", F.lit("x"), F.col("n").cast("string")))).alias("d"))
    return each.select("scope", "name", F.left(F.sha2("item", 256), F.lit(4)).alias("bucket"), "item", F.sha2(F.array_join("d", "\n"), 256).alias("digest"))


def buckets(found: DataFrame) -> DataFrame:
    """(scope, name, bucket, n, digest) of ``items``: up to 65,536 buckets of a name."""
    lines = F.array_sort(F.collect_list(F.concat("item", F.lit("\n"), "digest")))
    return found.groupBy("scope", "name", "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _compared(locked: DataFrame, now: DataFrame) -> DataFrame:
    keys = ["scope", "name", "bucket"]
    side = lambda df, end: df.select(*keys, F.col("n").alias(f"n_{end}"), F.col("digest").alias(f"d_{end}"))
    return side(locked, "then").join(side(now, "now"), keys, "full").withColumn("differs", ~F.col("d_then").eqNullSafe(F.col("d_now")))


def verify(locked: DataFrame, now: DataFrame) -> DataFrame:
    """(scope, name, verified, changed_buckets, n_then, n_now) of two tables of ``buckets``: a row for each name of either."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return _compared(locked, now).groupBy("scope", "name").agg((~F.bool_or("differs")).alias("verified"), F.count_if("differs").alias("changed_buckets"), total("n_then"), total("n_now"))


def changes(locked_items: DataFrame, now_items: DataFrame, locked: DataFrame, now: DataFrame) -> DataFrame:
    """(scope, name, item, change): added, removed or changed items, found by the buckets that differ alone."""
    keys = ["scope", "name", "bucket"]
    wanted = _compared(locked, now).filter("differs").select(*keys)
    side = lambda df, c: df.join(wanted, keys, "left_semi").select(*keys, "item", F.col("digest").alias(c))
    both = side(locked_items, "then").join(side(now_items, "now"), [*keys, "item"], "full").filter(~F.col("then").eqNullSafe(F.col("now")))
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select("scope", "name", "item", kind.alias("change"))


def migrate(locked: DataFrame, now: DataFrame) -> DataFrame:
    """The lock with the projects' buckets as they are now; refused with an error if the cases are not the sealed ones."""
    if not verify(locked, now).filter("scope = 'cases' AND NOT verified").isEmpty():
        raise ValueError("the sealed cases differ from the present ones: the lock stays as it is")
    return locked.filter("scope = 'cases'").unionByName(now.filter("scope = 'project'"))
