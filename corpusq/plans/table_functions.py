"""The engine's tools as table functions of a session, to be called from SQL text.

``grep`` and ``read_lines`` take any table with a column ``content`` and give its other columns with what they found; their
result's columns follow the table's.  ``search`` ranks stored postings; it is a function in SQL, so that its call becomes
part of the query's plan, terms and all.

    SELECT path, line_no, line FROM grep(TABLE(SELECT path, content FROM files), 'needle')
    SELECT * FROM read_lines(TABLE(SELECT path, content FROM files), 10, 20)
    SELECT * FROM search('what to look for', 10)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, Row, StringType, StructType

from corpusq.functions.text import STOP_WORDS, WORD
from corpusq.operators import bm25


def _given(table: AnalyzeArgument, added: StructType) -> AnalyzeResult:
    if not table.isTable or "content" not in table.dataType.names:
        raise ValueError("the table must have a column content")
    clash = {n.lower() for n in table.dataType.names} & {f.name.lower() for f in added} - {"content"}
    if clash:
        raise ValueError(f"the table must not have columns {sorted(clash)}")
    return AnalyzeResult(StructType([f for f in table.dataType if f.name != "content"] + list(added)))


def _rest(row: Row) -> list:
    return [v for n, v in zip(row.__fields__, row) if n != "content"]


class Grep:
    """Lines that hold the needle as it is written, with ``context`` lines on either side, as ``lines.grep``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, needle: AnalyzeArgument, case_sensitive: AnalyzeArgument | None = None, context: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _given(table, StructType().add("line_no", IntegerType()).add("line", StringType()).add("before", ArrayType(StringType())).add("after", ArrayType(StringType())))

    def eval(self, row: Row, needle: str, case_sensitive: bool = False, context: int = 2) -> Iterator[tuple]:
        if row["content"] is None or needle is None:
            return
        lines, wanted = row["content"].split("\n"), needle if case_sensitive else needle.lower()
        for i, line in enumerate(lines):
            if wanted in (line if case_sensitive else line.lower()):
                yield (*_rest(row), i + 1, line, lines[max(0, i - context) : i], lines[i + 1 : i + 1 + context])


class ReadLines:
    """content cut to lines first to last, from 1, with total_lines, as ``lines.read_lines``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, first: AnalyzeArgument | None = None, last: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _given(table, StructType().add("content", StringType()).add("total_lines", IntegerType()))

    def eval(self, row: Row, first: int | None = None, last: int | None = None) -> Iterator[tuple]:
        if row["content"] is None:
            yield (*_rest(row), None, None)
            return
        lines = row["content"].split("\n")
        a = min(max(first or 1, 1), len(lines))
        b = len(lines) if last is None else min(max(last, a), len(lines))
        yield (*_rest(row), "\n".join(lines[a - 1 : b]), len(lines))


def search_sql(postings: str, lengths: str, name: str = "search") -> str:
    """CREATE FUNCTION for the ``local`` profile over two views."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    pattern = WORD.replace("\\", "\\\\")
    terms = f"filter(regexp_extract_all(lower(asked), '({pattern})', 1), t -> (length(t) > 1 OR NOT t RLIKE '^[a-z0-9]$') AND NOT array_contains(array({stop}), t))"
    # How often a term occurs in the query weighs it; the array is folded to a constant when the call is planned.
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked STRING, top_k INT) RETURNS TABLE (file_id STRING, chunk_id STRING, score DOUBLE) RETURN
    SELECT file_id, chunk_id, score FROM (
      SELECT file_id, chunk_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM (
        SELECT h.file_id, h.chunk_id, sum(h.qn * ln((st.n - df.df + 0.5D) / (df.df + 0.5D) + 1) * h.tf * ({bm25.K1}D + 1) / (h.tf + {bm25.K1}D * (1 - {bm25.B}D + {bm25.B}D * h.doc_length / st.mean))) AS score
        FROM (SELECT p.*, size(filter({terms}, t -> t = p.term)) AS qn FROM {postings} p WHERE array_contains({terms}, p.term)) h
        JOIN (SELECT term, count(DISTINCT file_id) AS df FROM {postings} WHERE array_contains({terms}, term) GROUP BY term) df ON df.term = h.term
        CROSS JOIN (SELECT count(*) AS n, CASE WHEN avg(length) > 0 THEN avg(length) ELSE 1D END AS mean FROM {lengths}) st
        GROUP BY h.file_id, h.chunk_id) WHERE score > 0) WHERE place <= top_k"""


def register(spark: SparkSession, postings: DataFrame | None = None, lengths: DataFrame | None = None, name: str = "search") -> None:
    """``grep`` and ``read_lines`` from now on in the session, and ``search`` over the given tables."""
    spark.udtf.register("grep", udtf(Grep))
    spark.udtf.register("read_lines", udtf(ReadLines))
    if postings is not None:
        sizes = postings.groupBy("file_id").agg({"doc_length": "max"}).toDF("file_id", "length") if lengths is None else lengths
        postings.select("term", "file_id", "chunk_id", "tf", "doc_length").createOrReplaceTempView(f"{name}_postings")
        sizes.select("file_id", "length").createOrReplaceTempView(f"{name}_lengths")
        spark.sql(search_sql(f"{name}_postings", f"{name}_lengths", name))
