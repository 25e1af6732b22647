"""Curated trees as two tables: clues(clue_id, project_id, name, description, principle, created_at, updated_at) and their nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators import tree

CLUES = "clue_id string, project_id string, name string, description string, principle string, created_at timestamp, updated_at timestamp"
NODES = "clue_id string, node_id string, parent_id string, pos int, kind string, name string, summary string, organization string, time_format string, file_id string, seg_type string, anchor_start int, anchor_end int"


def local_only(profile: str) -> None:
    """Curated trees are kept in the local profile; in the cloud there are none, and writing them is an error."""
    if profile == "cloud":
        raise NotImplementedError("curated trees are not kept in the cloud profile")


def create(spark: SparkSession, project: str, name: str, description: str = "", principle: str = "", organization: str = "tree", time_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row of clues and its root node; a time format stands only with a timeline."""
    key = f"clue-{uuid.uuid4().hex}"
    clue = spark.createDataFrame([(key, project, name, description, principle)], "clue_id string, project_id string, name string, description string, principle string").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    root = (key, f"{key}/root", None, 0, "folder", "", description, organization, time_format if organization == "timeline" else None, None, None, None, None)
    return clue, spark.createDataFrame([root], NODES)


def save(clues: DataFrame, nodes: DataFrame, clue: DataFrame, own: DataFrame, profile: str = "local") -> tuple[DataFrame, DataFrame]:
    """Both tables with one clue and its nodes, old rows of it replaced; another clue of that name in the project is an error."""
    local_only(profile)
    row = clue.first()
    taken = (F.col("project_id") == row["project_id"]) & (F.col("name") == row["name"]) & (F.col("clue_id") != row["clue_id"])
    if not clues.where(taken).isEmpty():
        raise ValueError(f"the project has a clue named {row['name']}")
    clues, nodes = delete(clues, nodes, row["clue_id"])
    return clues.unionByName(clue), nodes.unionByName(own.select(*nodes.columns))


def delete(clues: DataFrame, nodes: DataFrame, clue_id: str, profile: str = "local") -> tuple[DataFrame, DataFrame]:
    local_only(profile)
    return clues.where(F.col("clue_id") != clue_id), nodes.where(F.col("clue_id") != clue_id)


def listing(clues: DataFrame, nodes: DataFrame, project: str | None = None, profile: str = "local") -> DataFrame:
    """A project's clues (or all) by name, with the number of their leaves."""
    rows = clues.limit(0) if profile == "cloud" else clues if project is None else clues.where(F.col("project_id") == project)
    n = tree.leaves(nodes).groupBy("clue_id").agg(F.count("*").alias("leaf_count"))
    return rows.join(n, "clue_id", "left").select("clue_id", "name", "description", "updated_at", F.coalesce("leaf_count", F.lit(0)).alias("leaf_count")).orderBy("name", "clue_id")


def get(clues: DataFrame, nodes: DataFrame, clue_id: str, profile: str = "local") -> tuple[DataFrame, DataFrame]:
    """The clue's row and its nodes; both are empty if it is not known."""
    if profile == "cloud":
        return clues.limit(0), nodes.limit(0)
    return clues.where(F.col("clue_id") == clue_id), nodes.where(F.col("clue_id") == clue_id)


def references(clues: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """files(file_id) that leaves name, with clue_refs: (clue_id, clue_name, leaf_path) by path.  nodes have paths."""
    leaf = tree.leaves(nodes).join(files.select("file_id").distinct(), "file_id", "left_semi")
    rows = leaf.join(clues.select("clue_id", F.col("name").alias("clue_name")), "clue_id")
    order = F.array_sort(F.collect_list(F.struct(F.col("path").alias("leaf_path"), "clue_id", "clue_name")))
    return rows.groupBy("file_id").agg(F.transform(order, lambda x: F.struct(x["clue_id"].alias("clue_id"), x["clue_name"].alias("clue_name"), x["leaf_path"].alias("leaf_path"))).alias("clue_refs"))


def remove_files(nodes: DataFrame, file_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes without the files' leaves and the folders that this empties, and (clue_id, removed_leaves, removed_folders)."""
    kept = tree.remove_files(nodes, file_ids)
    gone = nodes.join(kept.select("clue_id", "node_id"), ["clue_id", "node_id"], "left_anti")
    return kept, gone.groupBy("clue_id").agg(F.count_if(F.col("kind") == "leaf").alias("removed_leaves"), F.count_if(F.col("kind") == "folder").alias("removed_folders"))
