"""Positioned text as lines; names in the order of a language."""

import os

import pytest

from corpusq.operators import pages, tree


def test_lines_of_fragments(spark):
    rows = [
        (1, 1, 0.0, 100.0, "The", False), (1, 2, 30.0, 101.5, " quick\t brown ", False), (1, 3, 60.0, 90.0, "fox", True), (1, 4, 0.0, 90.0, "jumps", False),
        (1, 5, 9.0, None, "over", False), (1, 6, 0.0, 90.5, "\0", False), (1, 7, 0.0, 80.0, " ", False), (1, 8, 0.0, 78.0, "end", False), (2, 1, 0.0, 1.0, None, True), (3, 1, 50.0, 5.0, "right", False), (3, 2, 10.0, 5.0, "left", False),
    ]
    df = spark.createDataFrame(rows, "page int, seq int, x double, y double, text string, eol boolean").repartition(3)
    assert {r.page: r.content for r in pages.assemble(df, "page").collect()} == {1: "The quick brown\nfox\njumps over\nend", 2: "", 3: "right left"}
    assert {r.page: r.content for r in pages.assemble(df, "page", by_x=True).collect()}[3] == "left right"
    assert pages.assemble(df.limit(0), "page").count() == 0


def test_names_in_the_order_of_a_language(spark):
    names = ["Zebra", "apple", "Äpfel", "banana", "Apple", "éclair", "zoo", "b", "阿", "中", "白"]
    got = [r.n for r in tree.by_name(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()]
    assert got != sorted(names)
    latin = [n for n in got if n.isascii() or n[0] in "Äé"]
    assert latin == ["Äpfel", "apple", "Apple", "b", "banana", "éclair", "Zebra", "zoo"]
    assert [n for n in got if n in "阿中白"] == ["阿", "白", "中"]


@pytest.mark.parametrize("name", ["assembled_lines", "import_commit", "sql_search", "sql_grep", "sql_read_lines"])
def test_queries_agree_with_sql(spark, name):
    from tests.test_queries import DATA, test_query_agrees_with_sql

    if not os.path.isdir(DATA):
        pytest.skip("no sample tables")
    test_query_agrees_with_sql(spark, name)


def test_table_functions_check_their_table(spark):
    from corpusq.plans import table_functions

    table_functions.register(spark)
    spark.createDataFrame([("p", "a\nB needle\nc", 1), ("q", None, 2)], "path string, content string, n int").createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT * FROM grep(TABLE(texts_of_test), needle => 'b N', context => 1)")
    assert got.columns == ["path", "n", "line_no", "line", "before", "after"] and [tuple(r) for r in got.collect()] == [("p", 1, 2, "B needle", ["a"], ["c"])]
    assert spark.sql("SELECT * FROM grep(TABLE(texts_of_test), 'b N', true)").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT path, content, total_lines FROM read_lines(TABLE(texts_of_test), 2) ORDER BY path").collect()] == [("p", "B needle\nc", 3), ("q", None, None)]
    for bad in ("SELECT * FROM grep(TABLE(SELECT 1 AS x), 'a')", "SELECT * FROM grep(TABLE(SELECT 'a' AS content, 1 AS Line), 'a')"):
        with pytest.raises(Exception, match="table must"):
            spark.sql(bad).collect()
