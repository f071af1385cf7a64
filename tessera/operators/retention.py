"""Seeds that belong to a selection: kept if a selected file is their neighbour, with room made where the set is full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<held:array<struct<path:string,loose:boolean>>,done:array<struct<path:string,outcome:string>>>"


def retain_seeds(selected: DataFrame, seeds: DataFrame, edges: DataFrame, limit: int, most: int = 3, near: int = 20) -> tuple[DataFrame, DataFrame]:
    """(selection, decisions) of tasks after their seeds were tried in turn.

    ``selected``: (task_id, project_id, path, pos, editable, confirmed), at most some dozens of a task; ``seeds``:
    (task_id, project_id, path, pos, editable, grounded); ``edges``: (project_id, src, dst, kind). The first ``most``
    editable seeds of a task count, in order. One that is selected already is passed over. Else it is left out as
    ungrounded without evidence of its own, as unrelated if none of its first ``near`` neighbours (what it imports,
    then what imports it, by path) is selected by then, seeds that were kept before it included. Where the selection
    has ``limit`` files or more, the first that is neither editable nor confirmed makes room; without one the seed is
    left out as full. A kept seed goes to the front.

    selection: (task_id, path, pos) from 0; decisions: (task_id, path, outcome): retained, ungrounded, unrelated, full.
    A task's files and seeds are gathered in one row, which ``limit`` and ``most`` bound; neighbours are cut to
    ``near`` before they meet a seed. Nothing but positions orders the outcome. Tasks with seeds only are kept.
    """
    ranked = seeds.filter("editable").withColumn("nth", F.row_number().over(Window.partitionBy("task_id").orderBy("pos", "path"))).filter(F.col("nth") <= most)
    ahead = edges.filter("kind <> 'imported-by' AND src <> dst").select("project_id", "src", "dst").distinct()
    both = ahead.select("project_id", F.col("src").alias("path"), F.col("dst").alias("other"), F.lit(0).alias("way")).unionByName(ahead.select("project_id", F.col("dst").alias("path"), F.col("src").alias("other"), F.lit(1).alias("way")))
    one = both.groupBy("project_id", "path", "other").agg(F.min("way").alias("way"))
    few = one.withColumn("nth", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("way", "other"))).filter(F.col("nth") <= near)
    around = few.groupBy("project_id", "path").agg(F.collect_set("other").alias("near"))
    tried = ranked.join(around, ["project_id", "path"], "left").groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "path", F.coalesce("grounded", F.lit(False)).alias("grounded"), F.coalesce("near", F.array().cast("array<string>")).alias("near")))).alias("seeds")
    )
    loose = ~F.coalesce("editable", F.lit(False)) & ~F.coalesce("confirmed", F.lit(False))
    held = selected.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", loose.alias("loose")))).alias("h"))
    rows = held.join(tried, "task_id", "full")
    start = F.struct(
        F.transform(F.coalesce("h", F.array().cast("array<struct<pos:int,path:string,loose:boolean>>")), lambda x: F.struct(x["path"].alias("path"), x["loose"].alias("loose"))).alias("held"),
        F.array().cast("array<struct<path:string,outcome:string>>").alias("done"),
    ).cast(_STATE)

    def try_seed(state, seed):
        kept = state["held"]
        paths = F.transform(kept, lambda x: x["path"])
        spot = F.array_position(F.transform(kept, lambda x: x["loose"]), F.lit(True))
        is_full = F.size(kept) >= limit
        room = F.when(is_full & (spot > 0), F.filter(kept, lambda x, i: i + 1 != spot)).otherwise(kept)
        outcome = (
            F.when(F.array_contains(paths, seed["path"]), F.lit(None).cast("string")).when(~seed["grounded"], "ungrounded")
            .when(~F.arrays_overlap(paths, seed["near"]), "unrelated").when(F.size(room) >= limit, "full").otherwise("retained")
        )
        new = F.concat(F.array(F.struct(seed["path"].alias("path"), F.lit(False).alias("loose"))), room)
        stays = F.when(outcome == "retained", new).when(outcome == "full", room).otherwise(kept)
        note = F.when(outcome.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(seed["path"].alias("path"), outcome.alias("outcome")))))
        return F.struct(stays.alias("held"), note.alias("done")).cast(_STATE)

    after = rows.select("task_id", F.aggregate(F.coalesce("seeds", F.array().cast("array<struct<nth:int,path:string,grounded:boolean,near:array<string>>>")), start, try_seed).alias("s"))
    selection = after.select("task_id", F.posexplode("s.held").alias("pos", "x")).select("task_id", "x.path", "pos")
    return selection, after.select("task_id", F.explode("s.done").alias("x")).select("task_id", "x.path", "x.outcome")
