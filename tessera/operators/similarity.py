"""Near-duplicate short texts by shared tokens and by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import holding
from .lineage import cut

#: Characters from which a text that stands within another says the same.
HELD = 24


def near_duplicate_lines(rows: DataFrame, group: str, threshold: float = 0.78) -> DataFrame:
    """(group, a, b) of rows ``(group, id, text)`` of one group that say the same: a < b.

    The same are equal texts, a text of 24 characters or more and one that holds it, and texts that share three tokens
    or more at a Jaccard similarity of ``threshold``. Of equal texts the smallest id stands for all: it is paired with
    each of the others, and alone with other texts, so that n copies give n - 1 pairs. Texts within others are found by
    ``containment.holding``, similar ones by a token: of n tokens, the n - ceil(threshold n) + 1 rarest in the group
    suffice, since similar texts share one of these. Empty texts and rows without a group are left out.
    """
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = cut(rows.select(group, "id", norm.alias("norm")).filter(f"norm <> '' AND {group} IS NOT NULL"))
    first = rows.groupBy(group, "norm").agg(F.min("id").alias("id"))
    equal = rows.withColumnRenamed("id", "b").join(first.withColumnRenamed("id", "a"), [group, "norm"]).filter("a < b").select(group, "a", "b")
    tokens = F.array_distinct(F.filter(F.split("norm", r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) >= 3))
    own = cut(first.withColumn("tokens", tokens))

    needles = own.filter(F.length("norm") >= HELD).select(group, F.col("id").alias("x"), F.col("norm").alias("literal"))
    held = holding(needles, own.select(group, F.col("id").alias("y"), F.col("norm").alias("text")), group).filter("x <> y")
    within = held.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    words = own.filter(F.size("tokens") >= 3).select(group, "id", F.explode("tokens").alias("token"))
    counts = words.groupBy(group, "token").agg(F.count("*").alias("n"))
    ranked = words.join(counts, [group, "token"]).groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    keep = lambda t: F.size(t) - F.ceil(F.size(t) * threshold - 1e-9).cast("int") + 1
    names = lambda t: F.transform(t, lambda x: x["token"])
    rare = ranked.select(group, "id", names(F.col("t")).alias("tokens"), F.explode(names(F.slice("t", 1, keep(F.col("t"))))).alias("token"))
    meet = rare.alias("p").join(rare.alias("q"), [group, "token"]).filter("p.id < q.id").select(group, F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.tokens").alias("ta"), F.col("q.tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    alike = meet.filter((shared >= 3) & (shared / (F.size("ta") + F.size("tb") - shared) >= threshold)).select(group, "a", "b")
    return equal.unionByName(within.unionByName(alike).distinct())
