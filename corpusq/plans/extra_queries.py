"""Registered queries: spreadsheets, chunking, JSON, analytics over the sample tables, and streams; each with its SQL where it has one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq.operators import chunking, sheets
from corpusq.sources.tables import read
from corpusq.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Line items as sheets: an order is a sheet, lines its rows, four columns.
CELLS = """cells AS (SELECT CAST(l_orderkey AS VARCHAR) AS sheet, l_linenumber AS row, unnest([1, 2, 3, 5]) AS col, unnest([CAST(CAST(l_quantity AS INT) AS VARCHAR), l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END, strftime(l_shipdate, '%Y-%m-%d')]) AS value FROM lineitem),
typed AS (SELECT *, CASE WHEN value = '' THEN 'Empty' WHEN col = 1 THEN 'Number' WHEN col = 5 THEN 'Date' ELSE 'Text' END AS dtype FROM cells)"""


def _cells(spark, d):
    rows = read(spark, d, "lineitem")
    one = lambda c, v: F.struct(F.lit(c).alias("col"), v.alias("value"))
    values = F.explode(F.array(one(1, F.col("l_quantity").cast("int").cast("string")), one(2, F.col("l_returnflag")), one(3, F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus"))), one(5, F.date_format("l_shipdate", "yyyy-MM-dd"))))
    cells = rows.select(F.col("l_orderkey").cast("string").alias("sheet"), F.col("l_linenumber").alias("row"), values.alias("c")).select("sheet", "row", "c.col", "c.value", F.lit("").alias("formula"))
    return cells.withColumns({"dtype": sheets.dtype(F.col("value"), F.col("formula")), "merge_type": F.lit("none"), "is_merge_master": F.lit(False), "hidden_row": F.lit(False), "bg": F.lit(""), "bordered": F.col("col") <= 2})


@query(f"WITH {CELLS} SELECT sheet, min(row) FILTER (value <> '')::INT AS top, min(col) FILTER (value <> '')::INT AS left, max(row) FILTER (value <> '')::INT AS bottom, max(col) FILTER (value <> '')::INT AS right FROM cells GROUP BY sheet")
def cells_bounds(spark, d):
    return sheets.bounds(_cells(spark, d))


@query(f"WITH {CELLS} SELECT dtype, count(*) AS n FROM typed GROUP BY dtype")
def cell_types(spark, d):
    return _cells(spark, d).groupBy("dtype").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, u AS (SELECT sheet, row, col, any_value(dtype) AS dtype FROM typed GROUP BY ALL HAVING count(*) = 1), p AS (SELECT *, lag(dtype) OVER (PARTITION BY sheet, col ORDER BY row) AS b FROM u) SELECT sheet, row, avg(CASE WHEN dtype <> b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM p WHERE b IS NOT NULL GROUP BY sheet, row HAVING ratio >= 0.25")
def type_diff(spark, d):
    c = _cells(spark, d)
    once = c.groupBy("sheet", "row", "col").agg(F.count("*").alias("n"), F.any_value("dtype").alias("dtype")).where("n = 1")
    return sheets.type_differences(once, "row", "mean", 0.25)


# Line items by supplier (large sheets) and by part (small ones); how often column 3 is empty depends on the supplier.
GRID = """l AS (SELECT 'S' || l_suppkey AS sheet, l_suppkey % 3 AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)::INT AS row FROM lineitem UNION ALL SELECT 'P' || l_partkey, l_partkey % 3, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey)::INT FROM lineitem),
g AS (SELECT *, CASE WHEN k = 0 THEN true WHEN k = 1 THEN row % 2 = 1 ELSE row % 7 <> 0 END AS has FROM l),
d AS (SELECT *, has <> lag(has) OVER (PARTITION BY sheet ORDER BY row) AS differs FROM g),
s AS (SELECT sheet, max(row) AS n, count(*) FILTER (differs) AS kept_rows, 2 + CASE WHEN bool_or(NOT has) THEN 1 ELSE 0 END + CASE WHEN bool_or(has) THEN 1 ELSE 0 END AS kept_cols FROM d GROUP BY sheet),
r AS (SELECT *, 1 - kept_rows / n::DOUBLE AS by_row, 1 - kept_cols / 5.0::DOUBLE AS by_col FROM s),
m AS (SELECT *, CASE WHEN n * 5 < 400 THEN 'none' WHEN by_row > by_col AND by_row > 0.1::DOUBLE THEN 'row' WHEN by_col > by_row AND by_col > 0.1::DOUBLE THEN 'column' ELSE 'none' END AS mode FROM r)"""


@query(f"WITH {GRID} SELECT sheet, mode, CASE mode WHEN 'row' THEN kept_rows WHEN 'column' THEN kept_cols END::INT AS kept, round(CASE mode WHEN 'row' THEN by_row WHEN 'column' THEN by_col ELSE 0 END, 6) AS ratio FROM m")
def compression_plan(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "lineitem")
    by = lambda name, key, *order: rows.select(F.concat(F.lit(name), F.col(key).cast("string")).alias("sheet"), (F.col(key) % 3).alias("k"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("row"))
    grid = by("S", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").unionByName(by("P", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"))
    has = F.when(F.col("k") == 0, True).when(F.col("k") == 1, F.col("row") % 2 == 1).otherwise(F.col("row") % 7 != 0)
    values = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in ((1, F.lit("17")), (2, F.lit("N")), (3, F.when(has, "O").otherwise("")), (5, F.lit("1996-03-13")))])
    cells = grid.select("sheet", "row", F.explode(values).alias("c")).select("sheet", "row", "c.col", "c.value", F.lit("").alias("formula"))
    cells = cells.withColumn("dtype", sheets.dtype(F.col("value"), F.col("formula")))
    got = sheets.compression_plans(cells, sheets.bounds(cells))
    return got.select("sheet", "mode", F.when(F.col("mode") != "none", F.size("kept")).alias("kept"), F.round("ratio", 6).alias("ratio"))


NATION_TABLE = "SELECT CAST(n_regionkey AS VARCHAR) AS sheet, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY n_nationkey) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey"


@query(NATION_TABLE)
def markdown_table(spark, d):
    one = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"))
    n = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("sheet"), F.col("n_nationkey").alias("row"), F.explode(F.array(one(1, F.col("n_nationkey")), one(2, F.col("n_name")))).alias("c"))
    return sheets.markdown_table(n.select("sheet", "row", "c.col", "c.value"))


@query(f"WITH {CELLS}, f AS (SELECT DISTINCT sheet, row FROM cells), i AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS part FROM f) SELECT sheet, min(row)::INT AS top, max(row)::INT AS bottom FROM i GROUP BY sheet, part HAVING max(row) > min(row)")
def connected_tables(spark, d):
    return sheets.tables(_cells(spark, d)).select("sheet", "top", "bottom")


@query(f"WITH {CELLS}, f AS (SELECT DISTINCT sheet, row FROM cells), g AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY sheet ORDER BY row) > 2 THEN 1 ELSE 0 END AS cut FROM f), i AS (SELECT *, sum(cut) OVER (PARTITION BY sheet ORDER BY row) AS part FROM g) SELECT sheet, min(row)::INT AS top, max(row)::INT AS bottom FROM i GROUP BY sheet, part")
def region_split(spark, d):
    return sheets.regions(_cells(spark, d).where("col <= 2")).select("sheet", "top", "bottom")


@query()
def chunk_markdown(spark, d):
    h = F.regexp_replace(F.regexp_replace("html", "<h1>(.*?)</h1>", "\n# $1\n\n"), "<p>", "\n\n## Part\n\n")
    return chunking.chunk_files(read(spark, d, "pages").select(F.col("page_id").alias("file_id"), h.alias("content"))).select("file_id", "idx", "tokens", "line_start", "line_end", F.length("content").alias("n_chars"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS line_end, CAST(ceil(length(text) / 4.0::DOUBLE) AS INT) AS tokens FROM documents")
def chunk_whole_documents(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text").withColumnRenamed("text", "content")
    got = chunking.chunk_files(docs, 400, 1 << 30)
    return got.select(F.col("file_id").cast("bigint").alias("doc_id"), "line_end", "tokens")


# Additions: windows, sessions, grouping sets, set operations ---------------------------------------------------------

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.tumbling(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, session")
def ext_session(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ext_setops(spark, d):
    o = read(spark, d, "orders")
    both = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))
    return both.subtract(read(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_nationkey, o_orderkey, rank FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3")
def ext_top_per_group(spark, d):
    from pyspark.sql import Window

    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_nationkey", "o_orderkey", "rank")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract(text, '^(\\S+)', 1) AS first_word FROM documents WHERE n_chars > 0")
def text_first_word(spark, d):
    return read(spark, d, "documents").where("n_chars > 0").select("doc_id", F.regexp_extract("text", r"^(\S+)", 1).alias("first_word"))


# Streams -------------------------------------------------------------------------------------------------------------

def _folder(spark) -> str:
    import tempfile

    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="streams-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drain(spark, rows, mode: str = "complete"):
    """Run a stream to its end; the last batch's table is the result of ``complete``, all batches' that of others."""
    at = _folder(spark)
    write = lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def _events(spark, d):
    schema = read(spark, d, "events").schema
    return jobs.events(spark, f"{d}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY event_type")
def stream_feed(spark, d):
    return _drain(spark, jobs.feed(_events(spark, d))).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return _drain(spark, jobs.tumbling(_events(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    return _drain(spark, jobs.jobs(_events(spark, d), "user_id", "10000 days").select("user_id"), "append")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'indexing' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, CASE event_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END::INT AS rejected FROM events")
def stream_states(spark, d):
    """Every event is a job that goes through three states, some of them out of order."""
    moves = {0: ("pending", "indexing", "indexed"), 1: ("pending", "indexed", "indexing"), 2: ("pending", "indexing", "failed"), 3: ("pending", "indexed", "pending")}
    step = lambda k: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("status")) for i, x in enumerate(moves[k])])
    kind = F.col("event_id") % 4
    steps = F.when(kind == 0, step(0)).when(kind == 1, step(1)).when(kind == 2, step(2)).otherwise(step(3))
    e = _events(spark, d).select("event_id", "ts", F.explode(steps).alias("s"))
    e = e.select("event_id", (F.col("ts") + F.make_dt_interval(secs=F.col("s.i"))).alias("ts"), F.col("s.status").alias("status"))
    return _drain(spark, jobs.states(e, "event_id"), "update")
