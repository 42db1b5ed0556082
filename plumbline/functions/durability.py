"""Cutting lineage on storage that outlives executors."""

from __future__ import annotations

from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    A session on a local master that names none gets a temporary folder; elsewhere it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
    return mkdtemp(prefix="plumbline-")


def durable(df: DataFrame) -> DataFrame:
    """Checkpointed copy in the session's shared folder, which outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint(eager=True)
