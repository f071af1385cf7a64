"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than this part of all rows are joined by broadcast: there are fewer than as many.
HOT = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an error, since
    executors do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``frames``, which nothing may read any more, and let go of the shuffles behind them."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {jvm.org.apache.hadoop.fs.Path(x).getParent().toString() for x in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(conf).delete(place, True)
    gc.collect()  # the driver's garbage holds shuffles on the executors' disks
    for df in frames[:1]:
        df.sparkSession.sparkContext._jvm.System.gc()


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of ``rows`` with ``side`` on ``key``, with a row for each key and, in ``weight``, its rows.

    Keys that hold more than 1/``HOT`` of all rows, of which there are fewer than ``HOT``, are broadcast, so that no
    task gathers them; the others meet by shuffle. Both inputs are read twice and should be materialized.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT > total
    heavy = F.broadcast(side.filter(hot))
    rest = rows.join(F.broadcast(side.filter(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(side.filter(~hot), key))


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
