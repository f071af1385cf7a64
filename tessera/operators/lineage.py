"""Cutting the lineage of iterative operators and of steps that many later ones read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back, deleted when the driver ends.

    A local session without that folder gets a temporary one; on a cluster it must be set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
