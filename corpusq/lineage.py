"""Cutting the lineage of iterative plans in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    A session within one JVM gets a temporary one where none is named; on a cluster that is an error, as executors don't
    see each other's local folders.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a compressed Parquet table in the checkpoint folder and read from it from now on.

    What was shuffled for them goes once they are written, and columns and rows that a plan doesn't use aren't read.
    """
    spark = df.sparkSession
    path, before = f"{folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the checkpoint folder from now on."""
    folder(df.sparkSession)
    return df.checkpoint()
