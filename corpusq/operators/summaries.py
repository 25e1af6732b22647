"""Directory summaries from the leaves up, made anew only where what they are made from has changed.

A directory's summary is made from the summaries of its files and of the directories right below it.  Levels are worked
from the deepest up: each joins the results of its children, which are known by then, so a tree of n levels takes n joins,
and each level's summaries are asked for in batches, in all tasks.  Every summary is kept with the content key of its
input, which covers all (name, summary) lines and the model's name; where the key is the same as before, the
old summary stays and nothing is asked.  A changed leaf therefore touches its ancestors only, and of these only up to
the first whose summary does not change.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.lineage import cut
from corpusq.operators.tree import folder_of

#: Lines of a request.
LINES = 1000
SCHEMA = "relative_path string, summary string, content_key string, made boolean"


def depth(path: Column) -> Column:
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def _asked(summarise: Callable[[list[tuple[str, str]]], list[str]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = summarise(list(zip(b.column("relative_path").to_pylist(), b.column("text").to_pylist()))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("relative_path"), pa.array([x or "" for x in got], pa.string()), b.column("content_key")], ["relative_path", "summary", "content_key"])

    return run


def inputs(directories: DataFrame, lines: DataFrame, model: str, most: int = LINES) -> DataFrame:
    """(relative_path, text, content_key): a directory's lines(relative_path, kind, name, summary) that are not blank, in order.

    A request has at most ``most`` lines and the number of the others; the key covers all of them.  The first lines are
    chosen before the shuffle and the key's sums combine there, so no task sees all of a large directory's files.
    """
    said = lines.where(F.trim(F.coalesce("summary", F.lit(""))) != "").select("relative_path", "kind", F.concat_ws(": ", "name", "summary").alias("line"))
    first = said.withColumn("n", F.row_number().over(Window.partitionBy("relative_path").orderBy("kind", "line"))).where(F.col("n") <= most)
    texts = first.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "line"))).alias("l"))
    add = lambda c: F.sum(c.cast("decimal(38,0)"))
    keys = said.groupBy("relative_path").agg(F.count("*").alias("all"), add(F.xxhash64("kind", "line")).alias("a"), add(F.conv(F.substring(F.md5(F.concat_ws("\n", "kind", "line").cast("binary")), 1, 15), 16, 10)).alias("b"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["kind"], F.lit(" "), x["line"])), "\n")
    text = F.concat(text, F.when(F.col("all") > most, F.concat(F.lit("\n(and "), (F.col("all") - most).cast("string"), F.lit(" more)"))).otherwise(""))
    rows = directories.select("relative_path").join(texts, "relative_path", "left").join(keys, "relative_path", "left")
    key = F.sha2(F.concat_ws(":", F.lit(model), F.col("all").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"), 256)
    return rows.select("relative_path", F.coalesce(text, F.lit("")).alias("text"), key.alias("content_key"))


def fold(directories: DataFrame, files: DataFrame, summarise: Callable[[list[tuple[str, str]]], list[str]], previous: DataFrame | None = None, model: str = "") -> DataFrame:
    """Rows of ``SCHEMA`` for all directories(relative_path), from files(path, summary), deepest level first.

    previous are such rows of the run before; ``made`` tells which summaries were asked for now.  summarise takes (path,
    text) pairs and is called with batches; a directory without anything to summarise has the empty summary.
    """
    dirs = cut(directories.select("relative_path").distinct().withColumn("depth", depth(F.col("relative_path"))))
    own = files.select(folder_of(F.col("path")).alias("relative_path"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "summary")
    known = dirs.sparkSession.createDataFrame([], SCHEMA) if previous is None else previous
    known = cut(known.select("relative_path", F.col("summary").alias("old"), F.col("content_key").alias("old_key")))
    out = below = dirs.sparkSession.createDataFrame([], SCHEMA)
    for level in range(dirs.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0], -1, -1):
        here = dirs.where(F.col("depth") == level)
        inner = below.select(F.when(F.col("relative_path").contains("/"), F.regexp_replace("relative_path", r"/[^/]*$", "")).otherwise(".").alias("relative_path"), F.lit("directory").alias("kind"), F.element_at(F.split("relative_path", "/"), -1).alias("name"), "summary")
        rows = inputs(here, own.unionByName(inner), model).join(known, "relative_path", "left")
        same = F.coalesce(F.col("content_key") == F.col("old_key"), F.lit(False))
        kept = rows.where(same | (F.col("text") == "")).select("relative_path", F.when(F.col("text") == "", "").otherwise(F.coalesce("old", F.lit(""))).alias("summary"), "content_key", F.lit(False).alias("made"))
        asked = rows.where(~same & (F.col("text") != "")).select("relative_path", "text", "content_key").mapInArrow(_asked(summarise), "relative_path string, summary string, content_key string")
        below = cut(kept.unionByName(asked.withColumn("made", F.lit(True))))
        out = out.unionByName(below)
    return out


def extract(most: int = 400) -> Callable[[list[tuple[str, str]]], list[str]]:
    """A summariser without a model: the number of lines, with those that the request only counts, and the first ``most`` characters of them."""

    def one(text: str) -> str:
        more = re.search(r"\n\(and (\d+) more\)$", text)
        text = text[: more.start()] if more else text
        return f"{len(text.splitlines()) + (int(more[1]) if more else 0)} entries. {' '.join(text.split())[:most]}"

    return lambda asked: [one(text) for _, text in asked]
