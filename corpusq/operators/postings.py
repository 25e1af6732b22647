"""Positional postings and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import tokens


def term_frequency(chunks: DataFrame, style: str = "index") -> DataFrame:
    return chunks.select("chunk_id", F.explode(tokens(F.col("content"), style)).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def build(chunks: DataFrame, style: str = "index") -> DataFrame:
    """chunks(file_id, dir_id, chunk_id, content[, locator, entry]) to postings, one row per term and chunk.

    Entries of one chunk that hold the term are merged in their order: the first locator stays and positions are
    appended.  Their order is that of ``entry``, or of the first line in their locators.  doc_length is the file's tokens.
    """
    if "locator" not in chunks.columns:
        chunks = chunks.withColumn("locator", F.lit("").cast("string"))
    if "entry" not in chunks.columns:
        chunks = chunks.withColumn("entry", F.coalesce(F.regexp_extract("locator", r"(\d+)", 1).try_cast("bigint"), F.lit(0)))
    rows = chunks.select("file_id", "dir_id", "chunk_id", "locator", "entry", tokens(F.col("content"), style).alias("terms"))
    sizes = rows.groupBy("file_id").agg(F.sum(F.size("terms")).cast("bigint").alias("doc_length"))
    flat = rows.select("file_id", "dir_id", "chunk_id", "locator", "entry", F.posexplode("terms").alias("pos", "term"))
    places = F.array_sort(F.collect_list(F.struct("entry", "locator", "pos")))
    found = flat.groupBy("term", "file_id", "dir_id", "chunk_id").agg(F.count("*").alias("tf"), places.alias("places"))
    found = found.select("term", "file_id", "dir_id", "chunk_id", "tf", F.col("places.pos").alias("positions"), F.get("places", F.lit(0))["locator"].alias("locator"))
    return found.join(sizes, "file_id")


def lengths(chunks: DataFrame, style: str = "index", unit: str = "file_id") -> DataFrame:
    """(unit, dir_id, length) of all files (or chunks) that have a token."""
    sizes = chunks.select(unit, "dir_id", F.size(tokens(F.col("content"), style)).cast("bigint").alias("n"))
    return sizes.groupBy(unit, "dir_id").agg(F.sum("n").alias("length")).where("length > 0")


def per_file(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "file_id").agg(F.sum("tf").alias("tf_sum"), F.count_distinct("chunk_id").alias("chunk_count"), F.max("doc_length").alias("doc_length"))


def document_frequency(postings: DataFrame, unit: str = "file_id") -> DataFrame:
    """Number of files (or, with unit chunk_id, of chunks) that hold each term."""
    return postings.groupBy("term").agg(F.count_distinct(unit).alias("df"))


def dir_stats(postings: DataFrame) -> DataFrame:
    files = postings.groupBy("dir_id", "file_id").agg(F.max("doc_length").alias("n"))
    return files.groupBy("dir_id").agg(F.count("*").alias("total_docs"), F.avg("n").alias("avg_doc_length"))


def cloud_dir_stats(postings: DataFrame) -> DataFrame:
    files = postings.groupBy("dir_id", "file_id").agg(F.sum("tf").alias("n"))
    return files.groupBy("dir_id").agg(F.count_distinct("file_id").alias("total_docs"), F.avg("n").alias("avg_doc_length"))


def scope_stats(stats: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    """Sums over the directories of a scope; the mean length is weighted by files."""
    rows = stats if dirs is None else stats.where(F.col("dir_id").isin(*dirs))
    n = F.sum("total_docs")
    return rows.agg(F.coalesce(n, F.lit(0)).alias("total_docs"), F.coalesce(F.sum(F.col("total_docs") * F.col("avg_doc_length")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_doc_length"))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings in which the files of ``new`` have only their new rows."""
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def remove(rows: DataFrame, column: str, ids: list) -> DataFrame:
    """Without the rows of the given ids; repeated and empty ids count once or not at all."""
    wanted = sorted({i for i in ids if i not in (None, "")}, key=str)
    return rows.where(~F.col(column).isin(*wanted)) if wanted else rows


def first_positions(postings: DataFrame) -> DataFrame:
    w = Window.partitionBy("term", "file_id").orderBy("chunk_id")
    return postings.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
