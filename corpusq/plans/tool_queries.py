"""Registered queries: result texts, curated trees, directory scopes, tickets, estimates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions import text as X
from corpusq.operators import clues, fusion, pages, tickets, tree
from corpusq.plans import retrieval
from corpusq.plans.text_queries import NODES, _nodes
from corpusq.sources.tables import read

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT CAST(user_id AS VARCHAR) AS chunk_id, max(value) AS score FROM events WHERE value >= 5.0::DOUBLE GROUP BY user_id")
def best_per_chunk(spark, d):
    return fusion.best_per_chunk(read(spark, d, "events").select(F.col("user_id").cast("string").alias("chunk_id"), F.col("value").alias("score")), 5.0)


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) AND event_id > 100 THEN event_id - 100 END AS n FROM events")
def positive_ints(spark, d):
    n = (F.col("event_id") - 100).cast("string")
    kind = F.col("event_id") % 5
    value = F.when(kind == 0, n).when(kind == 1, F.concat(F.lit("  "), n, F.lit(" lines"))).when(kind == 2, F.concat(n, F.lit(".9"))).when(kind == 3, F.concat(F.lit("x"), n)).otherwise("")
    return read(spark, d, "events").select("event_id", X.positive_int(value).alias("n"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS by_length, CAST(ceil(length(text) / 100.0::DOUBLE * 37) AS BIGINT) AS by_sample FROM documents")
def token_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", X.tokens_by_length(F.col("text")).alias("by_length"), X.tokens_by_sample(F.length("text"), F.lit(100), F.lit(37)).alias("by_sample"))


@query("SELECT doc_id, md5(text) AS content, source AS summary, CAST(NULL AS VARCHAR) AS other FROM documents")
def archive_parts(spark, d):
    a = read(spark, d, "documents").select("doc_id", X.archive(("content.md", F.col("text")), ("summaries.json", F.col("source"))).alias("a"))
    part = lambda name: F.try_element_at("a", F.lit(name))
    return a.select("doc_id", F.md5(part("content.md").cast("binary")).alias("content"), part("summaries.json").alias("summary"), part("metadata.json").alias("other"))


@query("WITH p AS (SELECT doc_id % 400 AS f, source || '/' || lang || '/' || doc_id AS path, doc_id, unnest(['.', source, source || '/' || lang]) AS relative_path FROM documents) SELECT relative_path, CAST(f AS VARCHAR) AS file_id, arg_min(CAST(doc_id AS VARCHAR), path) AS archive FROM p GROUP BY relative_path, f")
def descendant_files(spark, d):
    key = F.col("doc_id").cast("string")
    files = read(spark, d, "documents").select((F.col("doc_id") % 400).cast("string").alias("file_id"), key.alias("archive"), F.concat_ws("/", "source", "lang", key).alias("path"))
    return tree.descendant_files(files)


def _directories(spark, d):
    docs = read(spark, d, "documents")
    dirs = tree.directories(docs.select(F.lit("p").alias("project_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("path")))
    dirs = dirs.select(F.concat(F.lit("d:"), "relative_path").alias("dir_id"), "project_id", "relative_path", F.when(F.col("relative_path") != ".", F.concat(F.lit("d:"), tree.folder_of(F.col("relative_path")))).alias("parent_dir_id"))
    files = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("d:"), F.concat_ws("/", "source", "lang")).alias("dir_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("summary"), F.when(F.col("doc_id") % 7 > 0, "indexed").otherwise("failed").alias("status"))
    return dirs, files


SCOPED = "SELECT CAST(doc_id AS VARCHAR) AS file_id, {path} AS path, CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END AS summary FROM documents WHERE doc_id % 7 > 0"


@query(SCOPED.format(path="lang || '/' || doc_id || '.md'") + " AND source = 'src1'")
def scoped_files(spark, d):
    return tree.scoped_files(*_directories(spark, d), "d:src1")


@query(SCOPED.format(path="source || '/' || lang || '/' || doc_id || '.md'"))
def project_files(spark, d):
    return tree.scoped_files(*_directories(spark, d), "p")


@query("""WITH f AS (SELECT source || '/' || lang AS path, to_json(list({'name': doc_id || '.md', 'summary': CASE WHEN doc_id % 3 > 0 THEN lang END} ORDER BY doc_id || '.md')) AS files FROM documents WHERE doc_id % 7 > 0 GROUP BY 1), p AS (SELECT DISTINCT unnest(['.', source, source || '/' || lang]) AS path FROM documents) SELECT p.path AS relative_path, coalesce(CAST(f.files AS VARCHAR), '[]') AS files FROM p LEFT JOIN f USING (path)""")
def directory_files(spark, d):
    return tree.with_files(*_directories(spark, d)).select("relative_path", "files")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 60 SECOND > (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def live_tickets(spark, d):
    e = read(spark, d, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    rows = e.select("event_id", tickets.expiry(F.col("ts")).alias("expires_at")).crossJoin(F.broadcast(now))
    return tickets.live(rows, F.col("now")).select("event_id")


# Regions as clues: nations are their folders, suppliers the leaves, which name the files.
CLUES = f"{NODES}, clue_leaves AS (SELECT r.id AS clue_id, r.name AS clue_name, n.id AS folder, n.name || '/' || s.name AS leaf_path, s.id AS leaf, 'f' || (CAST(substr(s.id, 2) AS INT) % 40) AS file_id FROM nodes s JOIN nodes n ON s.parent_id = n.id JOIN nodes r ON n.parent_id = r.id)"


def _clues(spark, d):
    n = _nodes(spark, d)
    up = n.where("id like 'n%'").select(F.col("id").alias("up"), F.col("parent_id").alias("top"))
    clue = F.when(F.col("id").startswith("r"), F.col("id")).when(F.col("id").startswith("n"), F.col("parent_id")).otherwise(F.col("top"))
    leaf = F.col("id").startswith("s")
    rows = n.join(up, n["parent_id"] == up["up"], "left").select(clue.alias("clue_id"), F.col("id").alias("node_id"), "parent_id", F.substring("id", 2, 9).cast("int").alias("pos"), F.when(leaf, "leaf").otherwise("folder").alias("kind"), "name", F.when(leaf, F.concat(F.lit("f"), (F.substring("id", 2, 9).cast("int") % 40).cast("string"))).alias("file_id"))
    heads = n.where("parent_id is null").select(F.col("id").alias("clue_id"), F.lit("p").alias("project_id"), "name", F.lit("").alias("description"), F.lit("").alias("principle"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    return heads, rows


@query(f"WITH {CLUES} SELECT r.id AS clue_id, r.name, (SELECT count(*) FROM clue_leaves l WHERE l.clue_id = r.id) AS leaf_count FROM nodes r WHERE r.parent_id IS NULL")
def clue_list(spark, d):
    return clues.listing(*_clues(spark, d), "p").select("clue_id", "name", "leaf_count")


@query(f"WITH {CLUES} SELECT file_id, string_agg(clue_id || ':' || clue_name || ':' || leaf_path, ';' ORDER BY leaf_path, clue_id) AS refs FROM clue_leaves GROUP BY file_id")
def clue_references(spark, d):
    heads, nodes = _clues(spark, d)
    got = clues.references(heads, tree.paths(nodes), nodes.where("file_id is not null").select("file_id"))
    return got.select("file_id", F.array_join(F.transform("clue_refs", lambda r: F.concat_ws(":", r["clue_id"], r["clue_name"], r["leaf_path"])), ";").alias("refs"))


@query(f"WITH {CLUES}, g AS (SELECT clue_id, folder, count(*) FILTER (file_id IN ('f1', 'f2', 'f3')) AS gone, count(*) AS n FROM clue_leaves GROUP BY clue_id, folder) SELECT clue_id, CAST(sum(gone) AS BIGINT) AS removed_leaves, count(*) FILTER (gone = n) AS removed_folders FROM g GROUP BY clue_id HAVING sum(gone) > 0")
def clue_removed(spark, d):
    return clues.remove_files(tree.paths(_clues(spark, d)[1]), ["f1", "f2", "f3"])[1]


def _archived(spark, d):
    """Conversations as paged documents, turns as chunks; every third chunk has no range, every fourth item has its own."""
    t = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).alias("page"), F.col("text").alias("content"))
    doc = pages.with_markers(t, "file_id", "page").withColumnRenamed("markdown", "content_md")
    at = doc.select("file_id", F.posexplode("mapping").alias("i", "m")).select("file_id", "i", (F.col("m.first_line") - 2).cast("int").alias("first"), F.col("m.last_line").cast("int").alias("last"))
    key = X.chunk_id(F.col("file_id"), F.col("i"))
    has = F.col("i") % 3 != 1
    chunks = at.select(key.alias("chunk_id"), "file_id", F.when(has, F.col("first")).alias("line_start"), F.when(has, F.col("last")).alias("line_end"), F.concat(F.lit("lines:"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")).alias("locator"))
    items = at.select("file_id", key.alias("chunk_id"), F.when(F.col("i") % 4 == 0, F.col("first") + 2).alias("line_start"), F.when(F.col("i") % 4 == 0, F.col("first") + 2).alias("line_end"), (1.0 / (1 + F.col("i"))).alias("score"))
    place = lambda m: F.struct(m["first_line"].cast("int").alias("start_line"), m["last_line"].cast("int").alias("end_line"), m["locator"].alias("locator"))
    archives = doc.select("file_id", "content_md", F.transform("mapping", place).alias("mapping"), F.concat(F.lit("about "), "file_id").alias("summary"))
    files = doc.select("file_id", F.concat(F.col("file_id"), F.when(F.col("file_id").cast("int") % 2 == 0, ".pdf").otherwise(".md")).alias("path"))
    return items, chunks, archives, files


PLACES = "m AS (SELECT conv_id, turn, text, len(string_split(text, chr(10))) + 2 AS n FROM conversations), o AS (SELECT *, coalesce(sum(n + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM m), x AS (SELECT *, CASE WHEN i % 4 = 0 THEN string_split(text, chr(10))[1] ELSE regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') END AS t FROM o), shown AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS content, conv_id || ':' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id FROM x)"


@query(f"WITH {PLACES} SELECT CAST(conv_id AS VARCHAR) AS file_id, chunk_id, content, CASE WHEN conv_id % 2 = 0 THEN 'page ' || (turn + 1) ELSE 'lines ' || (b + 1) || '-' || (b + n) END AS locator, 'about ' || conv_id AS summary FROM shown")
def hydrate_results(spark, d):
    return retrieval.hydrate(*_archived(spark, d)).select("file_id", "chunk_id", "content", "locator", "summary")


@query(f"WITH {PLACES}, k AS (SELECT conv_id, chunk_id, CASE WHEN strpos(c, 'the') > 0 THEN substr(c, greatest(strpos(c, 'the') - 24, 1), least(strpos(c, 'the') + 26, length(c)) - greatest(strpos(c, 'the') - 24, 1) + 1) ELSE substr(c, 1, 48) END AS cut, strpos(c, 'the') AS p, length(c) AS l, i FROM (SELECT *, regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM shown) WHERE c <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n FROM k) SELECT CAST(conv_id AS VARCHAR) AS file_id, string_agg(chunk_id || '=' || CASE WHEN p > 0 THEN CASE WHEN p > 25 THEN '...' ELSE '' END || cut || CASE WHEN p + 26 < l THEN '...' ELSE '' END ELSE cut END, '|' ORDER BY n) AS snippets FROM r WHERE n <= 3 GROUP BY conv_id")
def result_snippets(spark, d):
    items, chunks, archives, files = _archived(spark, d)
    got = retrieval.file_snippets(items.select("file_id", "chunk_id", "score"), files, " the ", chunks, archives, files)
    return got.select("file_id", F.array_join(F.transform("snippets", lambda s: F.concat_ws("=", s["chunk_id"], s["text"])), "|").alias("snippets"))
