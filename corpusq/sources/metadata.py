"""Metadata of directories and projects as JSON files, and the log of the indexing stages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.tree import prefixes

FILE = "struct<file_id:string,name:string,archive:string,hash:string,chunk_count:bigint,summary:string>"
CHILD = "struct<name:string,dir_id:string,has_index:boolean,file_count:bigint,summary:string,last_updated:string>"
DIRECTORY = f"dir_id string, project_id string, parent_dir_id string, relative_path string, directory_path string, summary string, files array<{FILE}>, subdirectories array<{CHILD}>"
REGISTRY = "projects array<struct<project_id:string,path:string,alias:string,summary:string,valid:boolean,last_updated:string>>"
LOG = "run_id string, stage string, item string, status string, millis bigint, error string, at timestamp"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The projects that a registry file lists."""
    return spark.read.schema(REGISTRY).json(path, multiLine=True).select(F.inline("projects"))


def directories(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per directory file below the paths (globs are allowed)."""
    return spark.read.schema(DIRECTORY).json(list(paths), multiLine=True)


def reachable(dirs: DataFrame) -> DataFrame:
    """Directories that can be walked to from their project's root: each is listed by its parent.

    No walk is needed: a directory is reached if all its ancestors are there and each lists the next.
    """
    child = dirs.select("project_id", F.col("relative_path").alias("up"), F.explode("subdirectories").alias("s"))
    listed = child.select("project_id", F.when(F.col("up") == ".", F.col("s.name")).otherwise(F.concat_ws("/", "up", "s.name")).alias("at"))
    roots = dirs.where("relative_path = '.'").select("project_id", F.lit(".").alias("at"))
    known = dirs.select("project_id", F.col("relative_path").alias("at")).distinct().join(listed.unionByName(roots).distinct(), ["project_id", "at"], "left_semi")
    steps = dirs.select("project_id", "relative_path", F.explode(prefixes(F.col("relative_path"))).alias("at")).distinct()
    n = steps.groupBy("project_id", "relative_path").agg(F.count("*").alias("need"))
    got = steps.join(known, ["project_id", "at"], "left_semi").groupBy("project_id", "relative_path").agg(F.count("*").alias("have"))
    whole = n.join(got, ["project_id", "relative_path"]).where("need = have")
    return dirs.join(whole.select("project_id", "relative_path"), ["project_id", "relative_path"], "left_semi").select(*dirs.columns)


def files(dirs: DataFrame) -> DataFrame:
    """The files of all directories, with their path within the project."""
    rows = dirs.select("project_id", "dir_id", "relative_path", F.inline("files"))
    return rows.withColumn("path", F.when(F.col("relative_path") == ".", F.col("name")).otherwise(F.concat_ws("/", "relative_path", "name"))).drop("relative_path")


def references(dirs: DataFrame) -> DataFrame:
    """Every subdirectory that a directory lists, by path."""
    rows = dirs.select("project_id", "dir_id", F.col("relative_path").alias("up"), F.inline("subdirectories").alias("name", "child_id", "has_index", "file_count", "summary", "last_updated"))
    path = F.when(F.col("up") == ".", F.col("name")).otherwise(F.concat_ws("/", "up", "name"))
    return rows.withColumn("path", path).drop("up").orderBy("project_id", "path")


def put(dirs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same dir_id."""
    return dirs.join(rows.select("dir_id"), "dir_id", "left_anti").select(*rows.columns).unionByName(rows)


def supported_files(spark: SparkSession, root: str, extensions: list[str], skip: str = ".index") -> int:
    """How many files an index of the folder would take in; the index's own folder is not counted."""
    from corpusq.sources.files import scan

    return scan(spark, root, extensions).where("supported").where(~F.col("relative_path").rlike(rf"(^|/){skip.replace('.', '[.]')}/")).count()


class StageLog:
    """A table of JSON lines below a path: what every stage of a run did, to which item, in how long."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id, self.rows = spark, path, run_id, []

    def run(self, stage: str, item: str, task: Callable):
        """Do the task; its time and outcome become a row, and an error goes on to the caller."""
        start = time.monotonic()
        error = None
        try:
            return task()
        except Exception as e:
            error = str(e)[:500]
            raise
        finally:
            self.rows.append((self.run_id, stage, item, "failed" if error is not None else "done", int(1000 * (time.monotonic() - start)), error))

    def flush(self) -> None:
        """Append the rows that have gathered."""
        if self.rows:
            rows = self.spark.createDataFrame(self.rows, "run_id string, stage string, item string, status string, millis long, error string")
            rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)
            self.rows = []

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(self.path)
