"""Bounded traces through a code base: from seeds over imports and symbols, with parents, trails and what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import cut

#: How a file was reached; a symbol's owner goes before an import, an import before an importer. Fixed values.
WAYS = ["seed", "defines_symbol", "imports", "imported_by"]
#: The layer that files of a role stand for. Fixed values.
LAYERS = {
    "ui": ["page", "component", "ui-component", "layout", "hook"], "api": ["api-route", "client-api", "server-entry"],
    "service": ["service", "utility"], "storage": ["repository", "db-schema", "store"], "contract": ["types", "schema"],
}


def _first(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", place).filter(F.col("nth") <= most).drop("nth")


def trace(
    seeds: DataFrame, symbols: DataFrame, files: DataFrame, facts: DataFrame, edges: DataFrame, hops: int = 3, most_files: int = 16, most_symbols: int = 32, near: int = 8, owners: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the traces of tasks.

    ``seeds``: (task_id, project_id, file, pos); ``symbols``: (task_id, symbol, pos), canonical, of which the first
    ``most_symbols`` count; ``files``: (project_id, path, role); ``facts``: (project_id, file, kind, symbol), canonical,
    of kinds declaration, state and reference; ``edges``: (project_id, src, dst, kind).

    nodes: (task_id, project_id, file, hop, place, way, symbol, parent, trail, role, strength), at most ``most_files``
    of a task. Each hop follows, from the files found last, the first ``near`` imports and importers by path, and, for
    each task symbol that a file has, the first ``owners`` files that declare it. What is new competes for the places
    that are left: by way (owners of symbols, imports, importers), then the parent's place, the symbol's, and the path;
    a file that several ways reach keeps the first. ``trail`` holds the files from the seed on. role: producer,
    state-owner, consumer or candidate, by what the file has of the task's symbols; strength: strong for owners that
    are seeds or were reached by a symbol, probable for other owners, reference for consumers, else weak.

    ends: (task_id, n_files, stopped, layers), a row for each task with a seed in the inventory: whether the limit of
    files stopped it, and the layers that none of its files stands for.

    Branching is bounded before each join (2 ``near`` edges a file, ``owners`` files a symbol), and frontiers by
    ``most_files``, so no hop grows with the square of a project. Seeds that are no files are left out.
    """
    inventory = files.select("project_id", F.col("path").alias("file"), F.col("role").alias("file_role"))
    asked = cut(_first(symbols.select("task_id", "symbol", F.col("pos").alias("at")), ["task_id"], ["at", "symbol"], most_symbols))
    ahead = edges.filter("kind <> 'imported-by' AND src <> dst").select("project_id", "src", "dst").distinct()
    out = _first(ahead.select("project_id", F.col("src").alias("parent"), F.col("dst").alias("file")), ["project_id", "parent"], ["file"], near).withColumn("way", F.lit(2))
    back = _first(ahead.select("project_id", F.col("dst").alias("parent"), F.col("src").alias("file")), ["project_id", "parent"], ["file"], near).withColumn("way", F.lit(3))
    steps = cut(out.unionByName(back).join(inventory.select("project_id", "file"), ["project_id", "file"], "left_semi"))
    wanted = facts.join(asked.select("symbol").distinct(), "symbol", "left_semi").distinct()
    has = cut(wanted.groupBy("project_id", "file", "symbol").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("declaration", "state", "reference")]))
    declared = _first(has.filter("declaration OR state").select("project_id", "symbol", "file"), ["project_id", "symbol"], ["file"], owners + 1)
    declared = cut(declared.join(inventory.select("project_id", "file"), ["project_id", "file"], "left_semi"))

    start = seeds.join(inventory.select("project_id", "file"), ["project_id", "file"], "left_semi").groupBy("task_id", "project_id", "file").agg(F.min("pos").alias("pos"))
    start = start.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("pos", "file"))).filter(F.col("place") <= most_files)
    none = F.lit(None).cast("string")
    found = cut(start.select("task_id", "project_id", "file", F.lit(0).alias("hop"), "place", F.lit(0).alias("way"), none.alias("symbol"), none.alias("parent"), F.array("file").alias("trail")))
    for hop in range(1, hops + 1):
        front = found.filter(F.col("hop") == hop - 1).select("task_id", "project_id", F.col("file").alias("parent"), F.col("place").alias("parent_place"))
        by_import = front.join(steps, ["project_id", "parent"]).withColumns({"symbol": none, "at": F.lit(0)})
        own = has.select("project_id", F.col("file").alias("parent"), "symbol")
        by_symbol = front.join(own, ["project_id", "parent"]).join(asked, ["task_id", "symbol"]).join(declared, ["project_id", "symbol"]).filter("file <> parent")
        # one place more was kept, since a file is no owner for itself
        by_symbol = _first(by_symbol, ["task_id", "parent", "symbol"], ["file"], owners).withColumn("way", F.lit(1))
        columns = ["task_id", "project_id", "file", "way", "parent_place", "at", "parent", "symbol"]
        new = by_import.select(columns).unionByName(by_symbol.select(columns))
        new = new.join(found.select("task_id", "project_id", "file"), ["task_id", "project_id", "file"], "left_anti")
        best = new.groupBy("task_id", "project_id", "file").agg(F.min(F.struct("way", "parent_place", "at", "parent", "symbol")).alias("b"))
        full = found.groupBy("task_id").agg(F.max("place").alias("taken"))
        order = Window.partitionBy("task_id").orderBy("b.way", "b.parent_place", "b.at", "file")
        placed = best.join(full, "task_id").withColumn("place", F.col("taken") + F.row_number().over(order)).filter(F.col("place") <= most_files)
        # trails follow the files that got a place, not all that competed
        trails = found.filter(F.col("hop") == hop - 1).select("task_id", "project_id", F.col("file").alias("parent"), F.col("trail").alias("parent_trail"))
        fresh = placed.select("task_id", "project_id", "file", "place", "b.way", "b.symbol", "b.parent").join(trails, ["task_id", "project_id", "parent"])
        fresh = fresh.select("task_id", "project_id", "file", F.lit(hop).alias("hop"), "place", "way", "symbol", "parent", F.concat("parent_trail", F.array("file")).alias("trail"))
        found = found.unionByName(cut(fresh))
    met = found.select("task_id", "project_id", "file").join(asked, "task_id").join(has, ["project_id", "file", "symbol"]).groupBy("task_id", "project_id", "file").agg(
        *[F.bool_or(k).alias(k) for k in ("declaration", "state", "reference")]
    )
    known = found.join(met, ["task_id", "project_id", "file"], "left").join(inventory, ["project_id", "file"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    role = F.when(yes("state"), "state-owner").when(yes("declaration"), "producer").when(yes("reference"), "consumer").otherwise("candidate")
    owner = yes("state") | yes("declaration")
    strength = F.when(owner & F.col("way").isin(0, 1), "strong").when(owner, "probable").when(yes("reference"), "reference").otherwise("weak")
    nodes = known.select(
        "task_id", "project_id", "file", "hop", "place", F.element_at(X.strings(*WAYS), F.col("way") + 1).alias("way"), "symbol", "parent", "trail", role.alias("role"), strength.alias("strength"), "file_role"
    )
    layer = F
    for name, roles in LAYERS.items():
        layer = layer.when(F.col("file_role").isin(roles), name)
    ends = nodes.groupBy("task_id").agg(F.count("*").alias("n_files"), F.collect_set(layer.otherwise(None)).alias("seen"))
    ends = ends.select("task_id", "n_files", (F.col("n_files") >= most_files).alias("stopped"), F.array_except(X.strings(*LAYERS), F.col("seen")).alias("layers"))
    return nodes.drop("file_role"), ends
