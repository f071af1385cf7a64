"""Joins of inventories, facts, edges, packs and runs; containment is always an equi-join on tokens or keys first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

#: What a specifier may resolve to, in order. Fixed values.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".css", ".scss", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]


def fold_path(path):
    """A path with ``.`` and ``..`` worked off; null if it climbs above its root."""
    return F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(s))),
        lambda a: F.array_join(a, "/"),
    )


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project_id, src, specifier, dst): imports whose file is in the inventory.

    ``imports``: (project_id, src, specifier). Relative specifiers start at the importing file's folder, ``@/`` at its
    workspace's ``src``; others name packages and stay unresolved. Of the candidate paths the first that exists counts.
    """
    s = F.col("specifier")
    root = P.workspace_root(F.col("src"))
    base = F.when(P.begins(s, "./", "../"), F.concat_ws("/", P.directory(F.col("src")), s)).when(
        P.begins(s, "@/"), F.concat(F.when(root == "src", "").otherwise(F.concat(root, F.lit("/"))), F.lit("src/"), F.substring(s, 3, 1 << 20))
    )
    found = imports.withColumn("base", fold_path(base)).filter("base is not null")
    # a file stands under each base that one of the candidates' endings makes its path of: two or three, not sixteen tries
    ends = F.filter(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(c).alias("end")) for k, c in enumerate(CANDIDATES)]), lambda x: F.endswith("path", x["end"]))
    targets = files.select("project_id", "path", F.explode(ends).alias("e")).select("project_id", "path", "e.pos", F.expr("left(path, length(path) - length(e.end))").alias("base"))
    hits = found.join(targets, ["project_id", "base"])
    return hits.groupBy("project_id", "src", "specifier").agg(F.min_by("path", "pos").alias("dst"))


def reverse_edges(edges: DataFrame, kind: str = "imported-by") -> DataFrame:
    """``edges(project_id, src, dst, kind)`` and their reverse under another kind."""
    back = edges.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(kind).alias("kind"))
    return edges.select("project_id", "src", "dst", "kind").unionByName(back)


def owner_consumer(declared: DataFrame, used: DataFrame, k: int = 8) -> DataFrame:
    """(project_id, symbol, owner, consumer): at most k consumers for each owner of a symbol, in order.

    ``declared``: (project_id, symbol, owner); ``used``: (project_id, symbol, consumer). An owner is no consumer of its
    own, which takes one away at most, so the k + 1 first consumers of a symbol are all that its owners can need: they
    are taken before the join, whose rows are thus bounded by k + 1 for each owner.
    """
    first = Window.partitionBy("project_id", "symbol").orderBy("consumer")
    few = used.select("project_id", "symbol", "consumer").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1).drop("rank")
    pairs = declared.select("project_id", "symbol", "owner").distinct().join(few, ["project_id", "symbol"]).filter("owner <> consumer")
    order = Window.partitionBy("project_id", "symbol", "owner").orderBy("consumer")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def import_distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance, via) of ``pairs(a, b)`` that are one or two edges apart; the first via in order."""
    one = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), ["a", "b"]).select("a", "b", F.lit(1).alias("distance"), F.lit(None).cast("string").alias("via"))
    first = edges.select(F.col("src").alias("a"), F.col("dst").alias("via")).distinct()
    second = edges.select(F.col("src").alias("via"), F.col("dst").alias("b")).distinct()
    two = pairs.join(first, "a").join(second, ["via", "b"]).select("a", "b", F.lit(2).alias("distance"), F.col("via").cast("string").alias("via"))
    best = one.unionByName(two).groupBy("a", "b").agg(F.min(F.struct("distance", "via")).alias("m"))
    return best.select("a", "b", "m.distance", "m.via")


def align_changes(changed: DataFrame, selected: DataFrame) -> DataFrame:
    """For each project: changed files that were selected, changed outside the selection, selected only, and a status.

    ``changed`` and ``selected``: (project_id, path), paths normalised.
    """
    c = changed.select("project_id", "path").distinct().withColumn("c", F.lit(True))
    s = selected.select("project_id", "path").distinct().withColumn("s", F.lit(True))
    both = c.join(s, ["project_id", "path"], "full").groupBy("project_id").agg(
        F.count_if(F.col("c") & F.col("s")).alias("overlap"), F.count_if(F.col("c") & F.col("s").isNull()).alias("outside"), F.count_if(F.col("s") & F.col("c").isNull()).alias("selected_only")
    )
    status = (
        F.when(F.col("overlap") + F.col("outside") == 0, "clean").when(F.col("overlap") + F.col("selected_only") == 0, "no-context")
        .when(F.col("outside") == 0, "aligned").when(F.col("overlap") > 0, "partial").otherwise("outside")
    )
    return both.withColumn("status", status)


def overlay_by_id(builtin: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """All built-in rows, and the custom ones whose key no built-in row has."""
    return builtin.unionByName(custom.join(builtin.select(key), key, "left_anti"))


def run_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(task_id, overlap, left_only, right_only, jaccard) of two selections ``(task_id, path)``."""
    a = left.distinct().withColumn("a", F.lit(1))
    b = right.distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["task_id", "path"], "full").groupBy("task_id").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )
    return both.withColumn("jaccard", F.round(F.col("overlap") / (F.col("overlap") + F.col("left_only") + F.col("right_only")), 3))


def value_conflicts(entries: DataFrame) -> DataFrame:
    """(project_id, value, n_entries, first_entry): values that more than one entry of a project holds."""
    held = entries.groupBy("project_id", "value").agg(F.countDistinct("entry_id").alias("n_entries"), F.min("entry_id").alias("first_entry"))
    return held.filter("n_entries > 1")


def validate_ranking(ranking: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked ids that are candidates, each at its first place, and those that are not.

    ``ranking``: (task_id, pos, id); ``candidates``: (task_id, id).
    """
    ranked = ranking.select("task_id", "id", "pos", F.lit(1).alias("ranked"), F.lit(0).alias("known"))
    told = known_ranking(ranked.unionByName(candidates.select("task_id", "id", F.lit(0).alias("ranked"), F.lit(1).alias("known")), allowMissingColumns=True))
    return told.filter("known").drop("known"), told.filter("not known").drop("known")


def known_ranking(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """(task_id, id, pos, known): ranked ids, each at its first place, and whether they are candidates; nulls are none.

    ``rows``: (task_id, id, pos, ranked, known); the last two, 0 or 1, tell ranked rows and candidates, which one row may
    be both. One aggregation; ``tasks``: rows are shuffled once, over so many.
    """
    if tasks is not None:
        rows = rows.repartition(tasks, "task_id", "id")
    both = rows.groupBy("task_id", "id").agg(F.min("pos").alias("pos"), F.max("ranked").alias("ranked"), F.max("known").alias("known")).filter("ranked = 1")
    return both.select("task_id", "id", "pos", ((F.col("known") == 1) & F.col("task_id").isNotNull() & F.col("id").isNotNull()).alias("known"))
