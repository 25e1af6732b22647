"""A corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import decontam, mix, quality, simhash, substring
from corpusq.llm.common import columns, prepare, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document of smallest doc_id stays."""
    return simhash.one_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; documents of which nothing is left go."""
    out = substring.deduplicate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with how many of its words the mix takes: mix_size, source_size, target and taken.

    Columns of the documents that have one of these names, in whatever case, are replaced.

    The mix is given as counts: documents with ``taken`` 0 stay, and none is repeated where ``taken`` exceeds its size.
    Taking the words is left to the reader, as only sizes are shuffled for a mix, never texts.
    """
    added = ("mix_size", "source_size", "target", "taken")
    got = mix.mix(docs, F.struct(*[c for c, name in zip(columns(docs), docs.columns) if name.lower() not in added]).alias("doc"))
    return got.select("row.doc.*", F.col("size").alias("mix_size"), *added[1:])


STAGES = [("quality", quality_stage), ("near duplicates", near_stage), ("repeated passages", substring_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; their tables go to the checkpoint folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
