"""Registered queries: pages, projects, imports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.operators import pages, projects
from corpusq.sources import imports
from corpusq.sources.tables import read

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), F.col("text").alias("content"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS markdown, count(*)::INT AS pages FROM conversations GROUP BY conv_id")
def pages_to_markdown(spark, d):
    got = pages.to_markdown(_turns(spark, d), "conv_id", "page")
    return got.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown"), F.size("mapping").alias("pages"))


MARKED = "m AS (SELECT conv_id, turn + 1 AS page, '<!-- page: ' || (turn + 1) || ' -->' || chr(10) || chr(10) || text AS content FROM conversations), n AS (SELECT *, len(string_split(content, chr(10))) AS n FROM m), o AS (SELECT *, coalesce(sum(n + 3) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)"


@query(f"WITH {MARKED} SELECT conv_id, 'page:' || page AS locator, (b + 3)::BIGINT AS first_line, (b + n)::BIGINT AS last_line FROM o")
def page_marker_mapping(spark, d):
    got = pages.with_markers(_turns(spark, d), "conv_id", "page").select("conv_id", F.explode("mapping").alias("m"))
    return got.select("conv_id", "m.locator", "m.first_line", "m.last_line")


@query("SELECT doc_id, p AS page, CAST(floor((p - 1) * (n_chars % 100 + 5) / 4.0::DOUBLE) AS BIGINT) + 1 AS first_line, greatest(CAST(floor((p - 1) * (n_chars % 100 + 5) / 4.0::DOUBLE) AS BIGINT) + 1, CAST(floor(p * (n_chars % 100 + 5) / 4.0::DOUBLE) AS BIGINT)) AS last_line FROM documents, range(1, 5) t(p)")
def page_proportional(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100 + 5).alias("lines"), F.lit(4).alias("pages"))
    return pages.proportional(docs, "doc_id", "lines", "pages")


# Every page begins and ends with lines of its own, and the same line stands on every page.
FRAMED = "m AS (SELECT conv_id, turn + 1 AS page, 'open ' || (turn + 1) || chr(10) || 'the same line' || chr(10) || text || chr(10) || 'close ' || (turn + 1) || '.' AS content FROM conversations), n AS (SELECT *, len(string_split(content, chr(10))) AS n FROM m), o AS (SELECT *, coalesce(sum(n + 3) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)"


@query(f"WITH {FRAMED} SELECT conv_id, page::INT AS page, (b + CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END)::INT AS first_line, (b + n)::INT AS last_line FROM o")
def page_locate(spark, d):
    number = F.col("page").cast("string")
    t = _turns(spark, d).withColumn("content", F.concat(F.lit("open "), number, F.lit("\nthe same line\n"), F.col("content"), F.lit("\nclose "), number, F.lit(".")))
    first = F.when(F.col("page") % 2 == 0, F.lit("the same line")).otherwise(F.concat(F.lit("open "), number))
    texts = t.select("conv_id", "page", F.array(first, F.concat(F.lit("close "), number, F.lit("."))).alias("texts"))
    return pages.locate(pages.to_markdown(t, "conv_id", "page"), texts, "conv_id", "page")


@query("SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE 'a' || chr(10) || 'b' END AS content FROM conversations")
def page_merge(spark, d):
    t = _turns(spark, d)
    direct = t.withColumn("content", F.when(F.col("page") % 2 == 1, F.col("content")).otherwise("  "))
    layout = t.select("conv_id", "page", F.explode(F.array(F.struct(F.lit(2).alias("ord"), F.lit("b").alias("content")), F.struct(F.lit(1).alias("ord"), F.lit("a").alias("content")))).alias("x")).select("conv_id", "page", "x.ord", "x.content")
    return pages.merge_texts(direct, layout, "conv_id", "page")


@query("SELECT source, CASE WHEN min(n_chars) >= 100 THEN 'direct' WHEN max(n_chars) < 100 THEN 'layout' ELSE 'hybrid' END AS way FROM documents GROUP BY source")
def page_route(spark, d):
    from corpusq.operators.lines import document_class, page_class

    k = document_class(read(spark, d, "documents").select("source", page_class(F.col("n_chars")).alias("kind")), "source")
    return k.select("source", pages.route(F.col("kind"), True).alias("way"))


def _projects(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("project_id"), F.concat(F.lit("/data/"), F.col("n_name")).alias("path"), F.col("n_name").alias("alias"), F.lit("s").alias("summary"), (F.col("n_nationkey") % 2 == 0).alias("valid"), F.lit("2024-01-01").cast("timestamp").alias("last_updated"))


@query("SELECT n_name AS alias, n_nationkey % 2 = 0 OR n_nationkey = 3 AS valid, 's' AS summary FROM nation UNION ALL SELECT 'new', true, 'pending'")
def project_register(spark, d):
    p = projects.register(_projects(spark, d), "/data/NATION_3", "x", "2024-02-02 00:00:00")
    return projects.register(p, "/data/new/", "p-new", "2024-02-02 00:00:00").select("alias", "valid", "summary")


@query("SELECT n_name AS alias, CASE WHEN n_nationkey = 4 THEN 'better' ELSE 's' END AS summary FROM nation WHERE n_nationkey % 2 = 0")
def project_summary(spark, d):
    return projects.set_summary(_projects(spark, d), "4", "better").where("valid").select("alias", "summary")


def _tables(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    return {
        "projects": _projects(spark, d),
        "directories": c.select(F.col("c_custkey").cast("string").alias("dir_id"), F.col("c_nationkey").cast("string").alias("project_id"), F.when(F.col("c_custkey") >= 25, (F.col("c_custkey") % 25).cast("string")).alias("parent_dir_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("summary")),
        "files": o.select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_custkey").cast("string").alias("dir_id"), F.col("o_orderdate").alias("indexed_at"), F.lit(" ").alias("summary")),
        "chunks": read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_id"), F.col("l_linenumber").alias("idx")),
    }


@query("SELECT 'projects' AS name, count(*) AS n FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'directories', count(*) FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT 'files', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7)")
def project_delete(spark, d):
    out = None
    for name, df in projects.delete(_tables(spark, d), "7").items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT CAST(o_orderkey AS VARCHAR) AS file_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 40")
def newest_files(spark, d):
    t = _tables(spark, d)
    return projects.newest_files(t["files"], t["directories"], "7").limit(40).select("file_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS dir_id FROM customer WHERE c_custkey >= 25 AND c_custkey % 25 = 6")
def sub_directories(spark, d):
    return projects.sub_directories(_tables(spark, d)["directories"], "6").select("dir_id")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS project_id, count(*) AS dirs, count(*) FILTER (c_acctbal > 0) AS dirs_covered, coalesce(any_value(f.n), 0) AS files, CAST(0 AS BIGINT) AS files_covered FROM customer LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) f ON f.k = c_nationkey GROUP BY c_nationkey")
def project_overview(spark, d):
    t = _tables(spark, d)
    return projects.overview(t["files"], t["directories"])


@query("SELECT x.name, CAST(coalesce(a.n_nationkey, b.n_nationkey) AS VARCHAR) AS project_id FROM (VALUES ('3'), ('/data/NATION_9'), ('none')) x(name) LEFT JOIN nation a ON CAST(a.n_nationkey AS VARCHAR) = x.name LEFT JOIN nation b ON '/data/' || b.n_name = x.name")
def project_lookup(spark, d):
    return projects.by_id_or_path(_projects(spark, d), spark.createDataFrame([("3",), ("/data/NATION_9",), ("none",)], "name string"))


@query("SELECT label AS file_id, count(*)::INT AS chunk_count, CASE WHEN bool_and(vec_id % 45 <> 0) THEN 'indexed' ELSE 'embedding' END AS status FROM embeddings GROUP BY label")
def import_status(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("file_id"), F.when(F.col("vec_id") % 45 != 0, F.col("embedding")).alias("content_vector"))
    return imports.import_status(e)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE array_to_string(string_split(text, chr(10))[least(2, len(string_split(text, chr(10)))) : least(3, len(string_split(text, chr(10))))], chr(10)) END AS content FROM documents")
def read_clue_leaf(spark, d):
    docs = read(spark, d, "documents")
    leaf = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 2 == 0, "document").otherwise("range").alias("seg_type"), F.lit(2).alias("anchor_start"), F.lit(3).alias("anchor_end"))
    return projects.read_leaf(leaf, docs.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))).select(F.col("file_id").alias("doc_id"), "content")


@query("SELECT event_id, 'token=*** at /home/***/x' AS line FROM events WHERE event_type <> '' ORDER BY event_id DESC LIMIT 200")
def log_tail(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("token=abc"), F.col("event_id").cast("string"), F.lit(" at /home/me/x")).alias("line"))
    return imports.log_tail(e, "event_id", "line").select("event_id", imports.clean_log(F.col("line")).alias("line"))
