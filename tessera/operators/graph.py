"""Graphs of files: tests and their sources, bounded traces, and what a rename reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .lineage import cut


def pair_tests(files: DataFrame) -> DataFrame:
    """(project_id, test, source): each test file and the file it tests.

    First the same path without its test mark and ``__tests__`` folder, then the same with ``src`` for ``tests``, else
    the first file of the project, by path, with the same stem in lower case. ``files``: (project_id, path).
    """
    mark = r"\.(test|spec)\.(tsx|jsx|ts|js)$"
    is_test = P.like(F.lower("path"), r"\.(test|spec|smoke|replay)\.|(^|/)(tests|__tests__)/")
    plain = F.regexp_replace("path", mark, ".$2")
    tests = files.filter(is_test).select(
        "project_id", F.col("path").alias("test"), F.regexp_replace(plain, r"(^|/)__tests__/", "$1").alias("one"), F.regexp_replace(plain, r"(^|/)tests?/", "$1src/").alias("two")
    )
    tests = tests.withColumn("stem", F.lower(P.stem(P.base_name(F.col("one")))))
    sources = files.filter(~is_test).select("project_id", F.col("path").alias("source"))
    stems = sources.withColumn("stem", F.lower(P.stem(P.base_name(F.col("source"))))).groupBy("project_id", "stem").agg(F.min("source").alias("source"))
    by = lambda name, rank: tests.select("project_id", "test", F.col(name).alias("source")).join(sources, ["project_id", "source"]).select("project_id", "test", "source", F.lit(rank).alias("rank"))
    loose = tests.join(stems, ["project_id", "stem"]).select("project_id", "test", "source", F.lit(3).alias("rank"))
    found = by("one", 1).unionByName(by("two", 2)).unionByName(loose)
    return found.groupBy("project_id", "test").agg(F.min_by("source", "rank").alias("source"))


def trace(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(task_id, node, hop): nodes within ``hops`` steps of ``seeds(task_id, node)`` over ``edges(a, b)``, at their nearest.

    Each step joins the newest nodes only; what was seen before drops out, and the steps are cut by checkpoints. The edges
    are made once; after the first step those that begin at the newest nodes are written alone, so that few of them are
    broadcast.
    """
    found = seeds.select("task_id", "node").distinct().withColumn("hop", F.lit(0))
    every = edge = cut(edges.select("a", "b").distinct())
    newest = found = cut(found)
    for hop in range(1, hops + 1):
        if hop > 1:
            edge = cut(every.join(newest.select(F.col("node").alias("a")).distinct(), "a", "left_semi"))
        step = newest.join(edge, newest["node"] == edge["a"]).select("task_id", F.col("b").alias("node")).distinct()
        newest = step.join(found.select("task_id", "node"), ["task_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            newest = cut(newest)
        found = found.unionByName(newest)
    return found


def rename_impact(bindings: DataFrame, declared: DataFrame, names: DataFrame) -> DataFrame:
    """(symbol, file, depth): files that a rename of ``names(symbol)`` reaches: where it is declared, then importers of
    those, through re-exports until nothing new is found.

    ``bindings``: (file, module, symbol, reexports); ``declared``: (file, symbol). Both are made once and written; a
    small step is broadcast to the bindings.
    """
    bindings = cut(bindings.select("file", "module", "symbol", "reexports").distinct())
    found = cut(declared.join(names, "symbol").select("symbol", "file", F.lit(0).alias("depth")).distinct())
    newest, depth = found, 0
    while True:
        depth += 1
        via = newest.select("symbol", F.col("file").alias("module"))
        step = bindings.join(via, ["symbol", "module"]).select("symbol", "file", "reexports")
        step = step.groupBy("symbol", "file").agg(F.bool_or("reexports").alias("reexports"))
        fresh = step.join(found.select("symbol", "file"), ["symbol", "file"], "left_anti")
        fresh = cut(fresh)
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh.select("symbol", "file", F.lit(depth).alias("depth")))
        newest = fresh.filter("reexports")
