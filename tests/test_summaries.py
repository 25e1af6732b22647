"""Directory summaries bottom-up: whole results, and what is asked for when something changes."""

import pytest
from pyspark.sql import functions as F

from corpusq.operators import summaries as S

FILES = [("a/b/c/one.md", "first"), ("a/b/two.md", "second"), ("a/x/three.md", "third"), ("four.md", "fourth"), ("a/b/blank.md", " "), ("a/b/none.md", None)]
DIRS = [".", "a", "a/b", "a/b/c", "a/x", "empty", "empty/inner"]


def frames(spark, files=FILES, dirs=DIRS):
    return spark.createDataFrame([(d,) for d in dirs], "relative_path string"), spark.createDataFrame(files, "path string, summary string")


def echo(asked):
    return [f"<{text}>".replace("\n", ";") for _, text in asked]


def brute(files=FILES, dirs=DIRS):
    out = {}
    for d in sorted(dirs, key=lambda p: -(0 if p == "." else p.count("/") + 1)):
        up = lambda p: p.rpartition("/")[0] or "."
        lines = sorted([("directory", f"{p.rpartition('/')[2]}: {s}") for p, s in out.items() if p != "." and up(p) == d and s] + [("file", f"{p.rpartition('/')[2]}: {s}") for p, s in files if up(p) == d and s and s.strip()])
        out[d] = "<" + ";".join(f"{k} {x}" for k, x in lines) + ">" if lines else ""
    return out


def test_levels_from_the_deepest_up(spark):
    got = {r.relative_path: r for r in S.fold(*frames(spark), echo).collect()}
    assert {p: r.summary for p, r in got.items()} == brute()
    assert {p for p, r in got.items() if r.made} == {".", "a", "a/b", "a/b/c", "a/x"}
    assert S.fold(*frames(spark, [], []), echo).count() == 0


def test_a_changed_leaf_touches_its_ancestors_only(spark):
    first = S.fold(*frames(spark), echo).cache()
    again = S.fold(*frames(spark), echo, first)
    assert again.where("made").count() == 0 and sorted(again.drop("made").collect()) == sorted(first.drop("made").collect())
    changed = [(p, "changed" if p == "a/b/two.md" else s) for p, s in FILES]
    got = {r.relative_path: r for r in S.fold(*frames(spark, changed), echo, first).collect()}
    assert {p for p, r in got.items() if r.made} == {".", "a", "a/b"} and {p: r.summary for p, r in got.items()} == brute(changed)
    # Where a directory's summary stays the same, nothing above is asked for.
    same = lambda asked: ["same"] * len(asked)
    first = S.fold(*frames(spark), same).cache()
    assert [r.relative_path for r in S.fold(*frames(spark, changed), same, first).where("made").collect()] == ["a/b"]
    assert S.fold(*frames(spark), same, first, model="other").where("made").count() == 5


def test_requests_are_bounded_and_keys_are_not(spark, monkeypatch):
    files = [(f"d/{i:04d}", f"s{i}") for i in range(50)]
    dirs, rows = frames(spark, files, [".", "d"])
    lines = rows.select(F.lit("d").alias("relative_path"), F.lit("file").alias("kind"), F.substring("path", 3, 9).alias("name"), "summary")
    one = S.inputs(dirs.where("relative_path = 'd'"), lines, "m", 10).first()
    assert one.text.split("\n") == [f"file {i:04d}: s{i}" for i in range(10)] + ["(and 40 more)"]
    other = S.inputs(dirs.where("relative_path = 'd'"), lines.withColumn("summary", F.when(F.col("name") == "0049", "x").otherwise(F.col("summary"))), "m", 10).first()
    assert other.text == one.text and other.content_key != one.content_key


def test_large_directories_count_all_their_entries(spark):
    files = [(f"d/{i:05d}", "s") for i in range(S.LINES + 500)]
    got = {r.relative_path: r.summary for r in S.fold(*frames(spark, files, [".", "d"]), S.extract(20)).collect()}
    assert got == {"d": "1500 entries. file 00000: s file 0", ".": "1 entries. directory d: 1500 en"}


def test_query_agrees_with_sql(spark):
    import os

    from tests.test_queries import DATA, test_query_agrees_with_sql

    if not os.path.isdir(DATA):
        pytest.skip("no sample tables")
    test_query_agrees_with_sql(spark, "directory_summaries")
