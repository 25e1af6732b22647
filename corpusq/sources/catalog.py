"""Versioned Parquet tables; the last numbered pointer names the current versions; one writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "chunks": "chunk_id string, file_id string, dir_id string, idx int, rel_path string, line_start int, line_end int, locator string, content string, tokens int, content_vector array<float>, indexed_at timestamp, deleted_at timestamp",
    "postings": "term string, file_id string, dir_id string, chunk_id string, tf bigint, positions array<int>, locator string, doc_length bigint",
    "archives": "file_id string, content_md string, mapping array<struct<start_line:int,end_line:int,locator:string>>, summary string, source_hash string",
    "files": "file_id string, dir_id string, name string, path string, type string, size bigint, hash string, status string, chunk_count int, summary string, error_message string, indexed_at timestamp",
    "directories": "dir_id string, project_id string, relative_path string, parent_dir_id string, summary string, file_count bigint, chunk_count bigint",
    "projects": "project_id string, path string, alias string, summary string, valid boolean, last_updated timestamp",
    "clue_nodes": "clue_id string, node_id string, parent_id string, pos int, kind string, name string, summary string, organization string, time_format string, file_id string, seg_type string, anchor_start int, anchor_end int",
    "clues": "clue_id string, project_id string, name string, description string, principle string, created_at timestamp, updated_at timestamp",
    "lexicon": "word string, n bigint, cost int",
    "memory": "project_id string, path string, content string, size bigint",
}


class Catalog:
    """Tables below a Hadoop path; every commit writes new versions and then moves the pointer once.

    With a tenant, rows have a tenant_id column, partitioned by it, and every read is filtered by it.
    """

    def __init__(self, spark: SparkSession, root: str, tenant: str | None = None):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant
        self.held: list[str] = []

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def current(self) -> dict[str, str]:
        last = self._pointers()[-1:]
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/pointers/{last[0]}").collect())) if last else {}

    def _pointers(self) -> list[str]:
        """Names of the committed pointers, oldest first; the last one is current."""
        fs, path = self._fs()
        at = path(f"{self.root}/pointers")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def schema(self, name: str) -> T.StructType:
        return T._parse_datatype_string(SCHEMAS[name])

    def exists(self, name: str) -> bool:
        return name in self.current()

    def read(self, name: str) -> DataFrame:
        """The table's current version; an unknown table is empty; another set of columns is an error."""
        version = self.current().get(name)
        if version is None:
            return self.spark.createDataFrame([], self.schema(name))
        df = self.spark.read.parquet(f"{self.root}/{name}/{version}")
        if self.tenant is not None:
            df = df.where(F.col("tenant_id") == self.tenant).drop("tenant_id")
        if set(df.columns) != set(self.schema(name).names):
            raise ValueError(f"{name} has columns {sorted(df.columns)}")
        return df

    def stage(self, df: DataFrame, kind: str = "rows") -> DataFrame:
        """The rows, computed once and kept below the catalog until ``release``: for what several tables of a commit are made from."""
        path = f"{self.root}/staging/{kind}/{uuid.uuid4().hex}"
        self.held.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def staged(self, kind: str) -> DataFrame | None:
        """What earlier runs staged whole and did not live to release; it is released with this run's."""
        fs, path = self._fs()
        at = path(f"{self.root}/staging/{kind}")
        found = [f"{self.root}/staging/{kind}/{f.getPath().getName()}" for f in fs.listStatus(at)] if fs.exists(at) else []
        found = [f for f in found if f not in self.held and fs.exists(path(f"{f}/_SUCCESS"))]
        self.held += found
        return self.spark.read.parquet(*found) if found else None

    def release(self) -> None:
        """Delete what this object staged or took over; other runs' folders stay."""
        fs, path = self._fs()
        for f in self.held:
            fs.delete(path(f), True)
        for f in [*dict.fromkeys(f.rpartition("/")[0] for f in self.held), f"{self.root}/staging"]:
            if fs.exists(path(f)) and not fs.listStatus(path(f)):
                fs.delete(path(f), False)
        self.held = []

    def commit(self, **tables: DataFrame) -> str:
        """Write new versions of the tables and make them current together."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema(name)])
            if self.tenant is None:
                df.write.parquet(f"{self.root}/{name}/{version}")
                continue
            out = df.withColumn("tenant_id", F.lit(self.tenant))
            before = self.current().get(name)
            if before is not None:
                others = self.spark.read.parquet(f"{self.root}/{name}/{before}").where(F.col("tenant_id") != self.tenant)
                out = out.unionByName(others)
            out.write.partitionBy("tenant_id").parquet(f"{self.root}/{name}/{version}")
        pointer = self.current() | dict.fromkeys(tables, version)
        fs, path = self._fs()
        known = self._pointers()
        number = int(known[-1].split(".")[0]) + 1 if known else 1
        draft = path(f"{self.root}/pointers/_{version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        at = path(f"{self.root}/pointers/{number:012d}.json")
        if fs.exists(at) or not fs.rename(draft, at):
            raise RuntimeError("another writer has committed in the meantime")
        for old in known[:-8]:
            fs.delete(path(f"{self.root}/pointers/{old}"), False)
        return version
