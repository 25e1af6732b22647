"""Rows from elsewhere: bulk imports, URLs, labelled queries, exports; and a cleaner for logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import private_host


def import_status(chunks: DataFrame) -> DataFrame:
    """The state of imported files: indexed if every chunk has a vector, else embedding."""
    return chunks.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"), F.when(F.bool_and(F.col("content_vector").isNotNull()), "indexed").otherwise("embedding").alias("status"))


def reembed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors by chunk_id in place of the old ones."""
    from corpusq.operators.changes import upsert

    return upsert(chunks, vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", ["content_vector"])


def export(chunks: DataFrame, archives: DataFrame, same_model: bool, least: int = 200, most: int = 400) -> DataFrame:
    """Chunks for another index: as they are where model and dimension agree, else cut anew without vectors."""
    if same_model:
        return chunks.select("file_id", "idx", "content", "locator", "content_vector")
    from corpusq.operators.chunking import chunk_files

    new = chunk_files(archives.select("file_id", F.col("content_md").alias("content")), least, most, padded=False)
    return new.select("file_id", "idx", "content", "locator", F.lit(None).cast("array<float>").alias("content_vector"))


def fetch(urls: DataFrame, get: Callable[[str], bytes], most: int = 100 << 20) -> DataFrame:
    """urls(url) to (url, content, error): a row for each, whether it could be had or not.

    get is called by the tasks, and must not follow redirects to hosts that ``private_host`` refuses.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for url, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, error = None, "this address is not allowed" if bad else None
                if not bad:
                    try:
                        content = get(url)
                        if len(content) > most:
                            content, error = None, "too large"
                    except Exception as e:
                        error = str(e)[:500]
                rows.append({"url": url, "content": content, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("url", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    return urls.select("url", private_host(F.col("url")).alias("bad")).mapInArrow(run, "url string, content binary, error string")


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, query string, keyword string, type string, expected_chunks array<string>, expected_files array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def clean_log(line: Column) -> Column:
    """Without what looks like keys, tokens, passwords and home folders."""
    x = F.regexp_replace(line, r"(?i)\b(api[_-]?key|token|secret|password|authorization)(\"?\s*[:=]\s*\"?)(bearer\s+)?[^\s\",;]+", "$1$2***")
    x = F.regexp_replace(x, r"\b(sk|pk|ghp|xox[abp])[-_][A-Za-z0-9_-]{8,}", "***")
    return F.regexp_replace(x, r"(/home/|/Users/)[^/\s]+", "$1***")


def log_tail(rows: DataFrame, order: str, line: str, n: int = 200) -> DataFrame:
    """The last n lines that aren't blank."""
    return rows.where(F.trim(line) != "").orderBy(F.col(order).desc()).limit(n)
