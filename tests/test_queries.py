"""A sample of the registered queries agrees with its SQL over the smallest tables, and all are registered."""

import math
import os

import pytest

import __spark_entry__ as entry
from corpusq.plans import extra_queries, project_queries, search_queries, text_queries, tool_queries

DATA = "/root/testdata/sf0.001"
MODULES = (search_queries, text_queries, extra_queries, project_queries, tool_queries)
SAMPLE = ("postings_build", "bm25_scoped", "knn_postfilter_compat", "hybrid_search_local", "keyword_snippets", "heading_sections", "line_to_page_overlap", "clue_cascade_remove", "ingest_diff", "eval_metrics", "region_split", "stream_feed", "cells_bounds", "cell_types", "type_diff", "compression_plan", "connected_tables", "read_clue_leaf", "sentence_split", "knn_batch", "page_locate", "safe_urls", "descendant_files", "scoped_files", "directory_files", "clue_references", "clue_removed", "hydrate_results", "result_snippets")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(value(r[n]) for n in names) for r in df.collect())
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    r = c.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(n) for n in names]
    assert got == sorted(tuple(value(row[i]) for i in at) for row in r.fetchall())


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(set(m.QUERIES) <= set(queries) for m in MODULES)
    assert len({n for m in MODULES for n in m.QUERIES}) == sum(len(m.QUERIES) for m in MODULES)
