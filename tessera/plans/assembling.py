"""The query of assembled contexts: suppliers' requests, their windows of files, and edges between neighbouring files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import code_graph as G
from ..operators import selection as S
from .bindings import part_files
from .scalars import inventory
from .selecting import windowed, work

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A part's file imports those of the parts this much further on, in the same project.
STEPS = [20, 60, 140]


def links(spark, sf_dir):
    """(project_id, src, dst, kind): what each file of the inventory imports, and its reverse."""
    named = part_files(spark, sf_dir).select("part", "project_id", "path")
    own = named.select(F.explode(F.array(*[F.col("part") + n for n in STEPS])).alias("part"), F.col("path").alias("src"))
    known = inventory(spark, sf_dir).select("project_id", F.col("path").alias("dst"), "kind", "role")
    both = own.join(named.withColumnRenamed("path", "dst"), "part").filter("src <> dst").select("project_id", "src", "dst").distinct().join(known, ["project_id", "dst"])
    ahead = both.select("project_id", "src", "dst", G.edge_kind(F.col("src"), F.col("dst"), F.col("kind"), F.col("role")).alias("kind"))
    return ahead.unionByName(ahead.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("imported-by").alias("kind")))


def assembly(spark, sf_dir):
    asks, same = S.alike(work(spark, sf_dir))
    tasks = S.profiles(asks)
    return S.each(A.assemble(windowed(spark, sf_dir, tasks), tasks.select("task_id", "raw_task", "review_only"), links(spark, sf_dir)), same)


QUERIES["ret_assembly"] = assembly
