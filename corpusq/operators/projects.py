"""Projects, their directories, files and notes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(projects: DataFrame, path: str, project_id: str, now: str) -> DataFrame:
    """A project by path: revived where it is known, else a new row waiting for its index."""
    path = path.rstrip("/")
    at = F.lit(now).cast("timestamp")
    if not projects.where(F.col("path") == path).isEmpty():
        here = F.col("path") == path
        return projects.withColumns({"valid": here | F.col("valid"), "last_updated": F.when(here, at).otherwise(F.col("last_updated"))})
    values = {"project_id": F.lit(project_id), "path": F.lit(path), "alias": F.lit(path.rpartition("/")[2]), "summary": F.lit("pending"), "valid": F.lit(True), "last_updated": at}
    row = projects.sparkSession.range(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in projects.schema])
    return projects.unionByName(row)


def upsert(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same path."""
    return projects.join(rows.select("path"), "path", "left_anti").unionByName(rows)


def set_summary(projects: DataFrame, project_id: str, summary: str) -> DataFrame:
    return projects.withColumn("summary", F.when(F.col("project_id") == project_id, F.lit(summary)).otherwise(F.col("summary")))


def create(projects: DataFrame, directories: DataFrame, row: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A project with its root directory; both tables are committed together."""
    values = {"dir_id": F.col("project_id"), "project_id": F.col("project_id"), "relative_path": F.lit("."), "file_count": F.lit(0), "chunk_count": F.lit(0)}
    root = row.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in directories.schema])
    return projects.unionByName(row), directories.unionByName(root)


def delete(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """All tables without the project: its directories, and what hangs on them by directory, then by file."""
    dirs = tables["directories"].where(F.col("project_id") == project_id).select("dir_id")
    files = tables["files"].join(dirs, "dir_id", "left_semi").select("file_id")
    out = {}
    for name, df in tables.items():
        if "project_id" in df.columns:
            out[name] = df.where(F.col("project_id") != project_id)
        elif "dir_id" in df.columns:
            out[name] = df.join(dirs, "dir_id", "left_anti")
        elif "file_id" in df.columns:
            out[name] = df.join(files, "file_id", "left_anti")
        else:
            out[name] = df
    return out


def by_id_or_path(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(name) with the project that has it as id, or else as path."""
    a = wanted.join(projects.select(F.col("project_id").alias("name"), F.col("project_id").alias("__i")), "name", "left")
    b = a.join(projects.select(F.col("path").alias("name"), F.col("project_id").alias("__p")), "name", "left")
    return b.select("name", F.coalesce("__i", "__p").alias("project_id"))


def newest_files(files: DataFrame, directories: DataFrame, project_id: str, at: str = "indexed_at") -> DataFrame:
    dirs = directories.where(F.col("project_id") == project_id).select("dir_id")
    return files.join(dirs, "dir_id", "left_semi").orderBy(F.col(at).desc(), "file_id")


def sub_directories(directories: DataFrame, dir_id: str) -> DataFrame:
    return directories.where(F.col("parent_dir_id") == dir_id)


def write_note(memory: DataFrame, project_id: str, path: str, content: str) -> DataFrame:
    """A project's note; paths that leave the project are refused."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith("/") or ".." in parts or not path.endswith(".md"):
        raise ValueError("a note's path must be a relative .md path within the project")
    rest = memory.where(~((F.col("project_id") == project_id) & (F.col("path") == path)))
    return rest.unionByName(memory.sparkSession.createDataFrame([(project_id, path, content, len(content.encode()))], memory.schema))


def notes(memory: DataFrame, project_id: str) -> DataFrame:
    return memory.where(F.col("project_id") == project_id).select("path", "content", "size")


def overview(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Covered and all documents and directories of every project; a blank summary doesn't count."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    d = directories.groupBy("project_id").agg(F.count("*").alias("dirs"), F.count_if(has(F.col("summary"))).alias("dirs_covered"))
    f = files.join(directories.select("dir_id", "project_id"), "dir_id").groupBy("project_id").agg(F.count("*").alias("files"), F.count_if(has(F.col("summary"))).alias("files_covered"))
    return d.join(f, "project_id", "left").fillna(0, ["files", "files_covered"])


def read_leaf(leaf: DataFrame, texts: DataFrame) -> DataFrame:
    """Leaves(file_id, seg_type, anchor_start, anchor_end) with their text: the document, or the anchored lines."""
    from corpusq.functions.text import line_slice

    whole = F.col("seg_type") == "document"
    both = leaf.join(texts.select("file_id", "content"), "file_id", "left")
    return both.withColumn("content", F.when(whole, F.col("content")).otherwise(line_slice(F.col("content"), F.col("anchor_start"), F.col("anchor_end"))))
