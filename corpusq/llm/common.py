"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch where a document's whole text goes to Python; 200 documents of 100 kB make 20 MB.
ARROW_ROWS = 400


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches from now on in the session, and a checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    A session within one JVM, as in tests, gets a temporary folder where none is named; on a cluster that is an error,
    as executors don't see each other's local folders.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table in the shared checkpoint folder and read them from there from now on.

    What was shuffled for them is removed as soon as they are written.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The columns by their whole names, whatever signs these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def rows_of(df: DataFrame, more: str) -> StructType:
    """The column ``row`` as it is and the columns of a DDL string after it."""
    return StructType([df.schema["row"], *StructType.fromDDL(more).fields])


def fold(column: Column | str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
