"""Sample tables seen as the engine's relations: files, chunks, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import chunk_id


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a file of one chunk; sources are directories."""
    d = read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(key.alias("file_id"), F.col("source").alias("dir_id"), key.alias("chunk_id"), F.col("text").alias("content"))


def conversations_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation a file, its turns the chunks, in five directories."""
    c = read(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    return c.select(key.alias("file_id"), F.concat(F.lit("dir"), (F.col("conv_id") % 5).cast("string")).alias("dir_id"), chunk_id(key, F.col("turn")).alias("chunk_id"), F.col("turn").cast("int").alias("idx"), F.col("role"), F.col("text").alias("content"))
