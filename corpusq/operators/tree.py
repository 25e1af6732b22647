"""Directory trees and curated trees as edge lists with materialised paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.lineage import cut


#: Fixed value: the language by which listings of names and paths are ordered where they are shown.
COLLATION = "zh"


def by_name(rows: DataFrame, name: str, collation: str = COLLATION) -> DataFrame:
    """Rows in the order of a language; equal ones, as in accents that it does not tell apart, in that of bytes."""
    return rows.orderBy(F.collate(name, collation), name)


def prefixes(path: Column) -> Column:
    """Every ancestor of a path and the path itself; ``.`` stands above all."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.when(path == ".", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))


def directories(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Directories of files(project_id, path), with ids kept from previous(project_id, relative_path, dir_id)."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    found = files.select("project_id", F.explode(prefixes(folder)).alias("relative_path")).distinct()
    found = found.withColumn("own", F.when(F.col("relative_path") == ".", F.col("project_id")).otherwise(F.substring(F.sha2(F.concat_ws(":", "project_id", "relative_path").cast("binary"), 256), 1, 16)))
    if previous is None:
        return found.withColumnRenamed("own", "dir_id")
    return found.join(previous.select("project_id", "relative_path", "dir_id"), ["project_id", "relative_path"], "left").select("project_id", "relative_path", F.coalesce("dir_id", "own").alias("dir_id"))


def rollup(counts: DataFrame, path: str, *measures: str) -> DataFrame:
    """Sums of counts(path, measures) over every directory and all below it."""
    return counts.select(F.explode(prefixes(F.col(path))).alias(path), *measures).groupBy(path).agg(*[F.sum(m).alias(m) for m in measures])


def related(a: Column, b: Column) -> Column:
    """Equal, ancestor or descendant."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def expand(nodes: DataFrame, roots: DataFrame, most: int | None = None, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(root, id, level) of all nodes below the roots, level 0 being the root; at most ``most`` levels; cycles end.

    One equi-join a level; each level is written to the checkpoint folder, so that it is computed once and plans stay small.
    """
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("child"), F.col(parent).alias("up"))
    level = roots.select(F.col(key).alias("root"), F.col(key).alias("id"), F.lit(0).alias("level"))
    out, n = level, 0
    while most is None or n < most:
        n += 1
        level = level.join(edges, level["id"] == edges["up"]).select("root", F.col("child").alias("id"), F.lit(n).alias("level"))
        level = cut(level.join(out.select("root", "id"), ["root", "id"], "left_anti").distinct())
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def scope(candidates: DataFrame, bases: DataFrame, path: str = "path") -> DataFrame:
    """Candidate directories that lie at or below one of bases(base): an equi-join on the candidates' own prefixes."""
    up = candidates.withColumn("base", F.explode(prefixes(F.col(path))))
    return up.join(bases.select("base").distinct(), "base", "left_semi").drop("base").distinct()


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def descendant_files(files: DataFrame) -> DataFrame:
    """(relative_path, file_id, archive): every directory with each file at or below it once, the archive of the nearest place.

    files(path, file_id, archive).  Rows rather than lists, as the root's list is the whole project.
    """
    at = folder_of(F.col("path"))
    rows = files.select("file_id", "archive", "path", F.explode(prefixes(at)).alias("relative_path"))
    near = F.struct(F.size(F.split("path", "/")).alias("depth"), "path")
    return rows.groupBy("relative_path", "file_id").agg(F.min_by("archive", near).alias("archive"))


def scoped_files(directories: DataFrame, files: DataFrame, scope_id: str) -> DataFrame:
    """(file_id, path, summary) of indexed files at or below a directory, or of a project, with paths from there on.

    directories(dir_id, project_id, parent_dir_id, relative_path), files(file_id, dir_id, name, summary, status).  The
    scope's path is one row, joined by project and path.
    """
    base = directories.where((F.col("dir_id") == scope_id) | ((F.col("project_id") == scope_id) & F.col("parent_dir_id").isNull()))
    base = base.groupBy("project_id").agg(F.min("relative_path").alias("base"))
    below = directories.select("project_id", "dir_id", "relative_path", F.explode(prefixes(F.col("relative_path"))).alias("base")).join(base, ["project_id", "base"])
    rows = below.join(files.where("status = 'indexed'").select("file_id", "dir_id", "name", "summary"), "dir_id")
    path = F.when(F.col("relative_path") == ".", F.col("name")).otherwise(F.concat_ws("/", "relative_path", "name"))
    inner = F.when(F.col("base") == ".", path).otherwise(F.substring(path, F.length("base") + 2, F.length(path)))
    return rows.select("file_id", inner.alias("path"), F.coalesce("summary", F.lit("")).alias("summary"))


def with_files(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Directories with ``files``, a JSON list of the names and summaries of their indexed files; ``[]`` where there is none."""
    one = F.struct("name", "summary")
    rows = files.where("status = 'indexed'").groupBy("dir_id").agg(F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("files"))
    return directories.join(rows, "dir_id", "left").withColumn("files", F.coalesce("files", F.lit("[]")))


def nest(rows: list, depth: int = 2, key: str = "dir_id", parent: str = "parent_dir_id") -> list[dict]:
    """Directories (dictionaries) as nested ``subdirectories``, ``depth`` levels below the roots; for trees that are shown."""
    below: dict = {}
    known = {r[key] for r in rows}
    for r in rows:
        below.setdefault(r[parent] if r[parent] in known else None, []).append(r)

    def node(r: dict, left: int) -> dict:
        inner = sorted(below.get(r[key], []), key=lambda c: c["relative_path"]) if left > 0 else []
        return r | {"subdirectories": [node(c, left - 1) for c in inner]}

    return [node(r, max(0, int(depth))) for r in sorted(below.get(None, []), key=lambda c: c["relative_path"])]


def paths(nodes: DataFrame) -> DataFrame:
    """clue nodes(node_id, parent_id, pos, name, kind) with path (names) and order (positions) from the root.

    Every node doubles the way up that it knows with each join, so a tree of n levels takes about log2(n) joins and no
    level is left out.  Nodes that hang from no root, or from each other in a circle, have no path and are left out.
    """
    w = lambda c: F.lpad(c.cast("string"), 8, "0")
    none = F.array().cast("array<string>")
    names = F.when(F.col("parent_id").isNull(), none).otherwise(F.array(F.trim("name")))
    known = cut(nodes.select(F.col("node_id").alias("id"), F.col("parent_id").alias("up"), names.alias("names"), F.array(w(F.col("pos"))).alias("places")))
    left = known.where("up is not null").count()
    while left:
        above = known.select(F.col("id").alias("up"), F.col("up").alias("__u"), F.col("names").alias("__n"), F.col("places").alias("__p"))
        longer = known.where("up is not null").join(above, "up").select("id", F.col("__u").alias("up"), F.concat("__n", "names").alias("names"), F.concat("__p", "places").alias("places"))
        known = cut(known.where("up is null").unionByName(longer))
        before, left = left, known.where("up is not null").count()
        if left == before:
            break
    whole = known.where("up is null").select(F.col("id").alias("node_id"), F.array_join("names", "/").alias("path"), F.array_join("places", "/").alias("order"))
    return nodes.join(whole, "node_id").select(*nodes.columns, "path", "order")


def find(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path of names; names are trimmed and blank ones ignored."""
    wanted = "/".join(x.strip() for x in path.split("/") if x.strip())
    return nodes.where(F.col("path") == wanted)


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("path") == path) | F.startswith("path", F.lit(path + "/"))) if path else nodes


def add_child(nodes: DataFrame, parent: str, node: DataFrame, position: int | None = None) -> DataFrame:
    """A new node (one row of the nodes' columns) under the folder ``parent``, the siblings after it moving on."""
    siblings = nodes.where(F.col("parent_id") == parent)
    row = node.first()
    if nodes.where((F.col("node_id") == parent) & (F.col("kind") == "folder")).isEmpty():
        raise ValueError("the parent must be a folder")
    if not row["name"].strip() or "/" in row["name"]:
        raise ValueError("a name must not be blank or hold a slash")
    if not siblings.where(F.trim("name") == row["name"].strip()).isEmpty():
        raise ValueError("the name is taken")
    at = siblings.count() if position is None else max(0, min(position, siblings.count()))
    moved = nodes.withColumn("pos", F.when((F.col("parent_id") == parent) & (F.col("pos") >= at), F.col("pos") + 1).otherwise(F.col("pos")))
    return moved.unionByName(node.withColumn("pos", F.lit(at).cast(nodes.schema["pos"].dataType)).withColumn("parent_id", F.lit(parent)))


def update(nodes: DataFrame, node_id: str, **values) -> DataFrame:
    """Changed columns of one node; the root stays, and a time format only stands with a timeline.

    A new name must not be blank, hold a slash or be a sibling's; where nodes have paths, the node's and those below it
    are moved along.
    """
    here = (F.col("node_id") == node_id) & F.col("parent_id").isNotNull()
    if "name" in values:
        name = values["name"].strip()
        if not name or "/" in name:
            raise ValueError("a name must not be blank or hold a slash")
        one = nodes.where(here).select("parent_id", *(["path"] if "path" in nodes.columns else [])).first()
        if one is not None and not nodes.where((F.col("parent_id") == one["parent_id"]) & (F.col("node_id") != node_id) & (F.trim("name") == name)).isEmpty():
            raise ValueError("the name is taken")
        if one is not None and "path" in nodes.columns:
            old = one["path"]
            new = f"{old.rpartition('/')[0]}/{name}".lstrip("/")
            below = F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path")))
            clue = nodes.where(here).select("clue_id").first()[0] if "clue_id" in nodes.columns else None
            same = F.col("clue_id") == clue if clue is not None else F.lit(True)
            nodes = nodes.withColumn("path", F.when(same & ((F.col("path") == old) | F.startswith("path", F.lit(old + "/"))), below).otherwise(F.col("path")))
    for name, value in values.items():
        nodes = nodes.withColumn(name, F.when(here, F.lit(value)).otherwise(F.col(name)))
    if "organization" in nodes.columns and "time_format" in nodes.columns:
        nodes = nodes.withColumn("time_format", F.when(F.col("organization") == "timeline", F.col("time_format")))
    return nodes


def remove(nodes: DataFrame, path: str) -> DataFrame:
    """Without the node at the path and all below it."""
    return nodes.where(~((F.col("path") == path) | F.startswith("path", F.lit(path + "/"))))


def remove_files(nodes: DataFrame, file_ids: list[str]) -> DataFrame:
    """Without the leaves of the files and the folders that this empties; folders that were empty before, and roots, stay.

    nodes have paths.  A folder goes if it had a leaf below it and all of them go.
    """
    gone = F.col("file_id").isin(*file_ids) if file_ids else F.lit(False)
    leaves = nodes.where("kind = 'leaf'").select("clue_id", F.explode(prefixes(F.col("path"))).alias("path"), F.coalesce(gone, F.lit(False)).alias("gone"))
    emptied = leaves.groupBy("clue_id", "path").agg(F.bool_and("gone").alias("all_gone")).where("all_gone")
    return nodes.join(emptied.where("path <> '.'"), ["clue_id", "path"], "left_anti")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'leaf'")


def render(nodes: list, depth: int | None = None) -> str:
    """Box drawing of a tree of rows with node_id, parent_id, pos, name, kind; deeper levels are left out."""
    below: dict = {}
    for n in nodes:
        below.setdefault(n["parent_id"], []).append(n)
    out: list[str] = []

    def walk(parent, indent: str, level: int) -> None:
        rows = sorted(below.get(parent, []), key=lambda n: n["pos"])
        for i, n in enumerate(rows):
            last = i == len(rows) - 1
            out.append(f"{indent}{'└── ' if last else '├── '}{n['name']}{'/' if n['kind'] == 'folder' else ''}")
            if depth is None or level < depth:
                walk(n["node_id"], indent + ("    " if last else "│   "), level + 1)

    for root in sorted(below.get(None, []), key=lambda n: n["pos"]):
        out.append(root["name"])
        walk(root["node_id"], "", 1)
    return "\n".join(out)
