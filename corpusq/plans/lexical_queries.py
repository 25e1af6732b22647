"""Registered queries: a learned lexicon and its segmentation, pruned postings, many hybrid queries in one plan; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq.functions.text import tokens
from corpusq.lineage import cut, folder, stored
from corpusq.operators import impact, pages, segmentation, summaries, tree
from corpusq.operators import postings as P
from corpusq.plans import indexing, retrieval, table_functions
from corpusq.plans.search_queries import CONV, DOC_TERMS, SQL_SCORE, TERMS, sql_bm25, sql_doc_bm25_top, sql_postings, sql_tokens
from corpusq.sources.catalog import Catalog
from corpusq.sources.tables import conversations_as_chunks, documents_as_chunks, read

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: The tables hold no ideographs, so each letter a to z stands for one, and spaces go: runs as long as sentences.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(0x4E00 + 37 * i) for i in range(26))
SQL_IDEOGRAPHS = f"replace(translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}'), ' ', '')"


def ideographs(spark, d):
    c = conversations_as_chunks(spark, d)
    return c.withColumn("content", F.replace(F.translate(F.lower("content"), LETTERS, IDEOGRAPHS), F.lit(" "), F.lit("")))


def _lexicon(spark, d):
    return segmentation.lexicon(cut(segmentation.ngrams(ideographs(spark, d), "content")), cohesion=3.0)


@query(f"""WITH r AS (SELECT unnest(regexp_extract_all({SQL_IDEOGRAPHS}, '\\p{{Han}}+')) AS run FROM conversations),
g AS (SELECT run[i : i + k - 1] AS word FROM (SELECT run, k, unnest(range(1, len(run) - k + 2)) AS i FROM r, range(1, 5) t(k))),
c AS MATERIALIZED (SELECT word, count(*) AS n FROM g GROUP BY word), often AS MATERIALIZED (SELECT * FROM c WHERE n >= 5),
total AS (SELECT sum(n) AS chars FROM c WHERE len(word) = 1),
s AS (SELECT word, n, word[1 : k] AS a, word[k + 1 :] AS b FROM (SELECT word, n, unnest(range(1, len(word))) AS k FROM often WHERE len(word) > 1)),
b AS (SELECT s.word, s.n FROM s JOIN often x ON x.word = s.a JOIN often y ON y.word = s.b, total GROUP BY s.word, s.n HAVING min(s.n::DOUBLE * chars / x.n / y.n) >= 3),
w AS (SELECT * FROM (SELECT word, n FROM often WHERE len(word) = 1 UNION ALL FROM b) ORDER BY n DESC, word LIMIT 65536)
SELECT word, n, CAST(floor(1000 * ln((SELECT sum(n)::DOUBLE FROM w) / n)) AS INTEGER) AS cost FROM w""")
def segment_lexicon(spark, d):
    return _lexicon(spark, d)


@query()
def segment_postings(spark, d):
    """Postings of segmented texts: tested against brute force."""
    own = segmentation.Segmenter.of(_lexicon(spark, d))
    return P.build(ideographs(spark, d), own).select("term", "file_id", "chunk_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "doc_length")


@query(sql_doc_bm25_top(20))
def bm25_blocks(spark, d):
    """As bm25_top_documents, from a stored table of blocks of which only those are read that can matter."""
    chunks = documents_as_chunks(spark, d)
    return impact.search(stored(impact.blocks_of(chunks)), DOC_TERMS, 20).select("chunk_id", F.round("score", 6).alias("score"))


#: Every conversation whose number 50 divides asks with its first turn; a turn's vector is that of a number made from its own.
TOP, ASKED = 10, 8


def _many(spark, d):
    chunks = conversations_as_chunks(spark, d)
    c, e = read(spark, d, "conversations"), read(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    keyed = c.crossJoin(F.broadcast(n)).withColumn("vec_id", (F.col("conv_id") * 31 + F.col("turn")) % F.col("n")).join(e.select("vec_id", "embedding"), "vec_id")
    own = chunks.join(keyed.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("idx"), "embedding"), ["file_id", "idx"])
    first = keyed.where("conv_id % 50 = 0").groupBy("conv_id").agg(F.min_by(F.struct("text", "embedding"), "turn").alias("x"))
    queries = first.select(F.col("conv_id").alias("query_id"), F.coalesce("x.text", F.lit("")).alias("text"), F.slice(tokens(F.col("x.text")), 1, ASKED).alias("terms"), F.col("x.embedding").alias("vector"))
    postings = stored(P.build(chunks).select("term", "file_id", "chunk_id", "tf", "doc_length"))
    return chunks.select("chunk_id", "file_id", "content"), postings, own.select("chunk_id", "embedding"), cut(queries)


def sql_many(method: str) -> str:
    lists = {"vector": "SELECT query_id, chunk_id, 0 AS li, 'vector' AS ln, rank FROM vl", "keyword": "SELECT query_id, chunk_id, 1 AS li, 'keyword' AS ln, rank FROM kl"}
    chosen = " UNION ALL ".join(v for k, v in lists.items() if method in (k, "hybrid"))
    head = "array_to_string(list_filter(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1:4], lambda x, i: i <= 2 OR regexp_matches(x, '^\\s*#{1,6}\\s')), chr(10))"
    lead, count = "substr(content, 1, 200)", lambda where: f"len(list_filter(qt, lambda t: contains({where}, t)))"
    phrase = " + ".join(f"CASE WHEN contains({where}, trim(q.text)) THEN {w}::DOUBLE ELSE 0 END" for where, w in (("content", 0.008), (lead, 0.012), (head, 0.016)))
    bonus = f"CASE WHEN len(trim(q.text)) >= 2 THEN {phrase} ELSE 0 END + least({count(head)}, 3) * 0.004::DOUBLE + least({count(lead)}, 4) * 0.002::DOUBLE + CASE WHEN {count(head)} > 0 AND regexp_matches({head}, '(?m)^\\s*#{{1,6}}\\s') THEN 0.006::DOUBLE ELSE 0 END"
    return f"""WITH {sql_postings(CONV)},
v AS (SELECT conv_id, turn, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS chunk_id, coalesce(text, '') AS text, embedding::DOUBLE[] AS embedding
      FROM (SELECT *, (conv_id * 31 + turn) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations) JOIN embeddings USING (vec_id)),
q AS (SELECT conv_id AS query_id, text, ({sql_tokens('text')})[1:{ASKED}] AS terms, embedding AS q,
      list_distinct(list_filter(string_split_regex(regexp_replace(text, '[（(][^）)]*[）)]', ' ', 'g'), '[\\s,，。;；:：、!！?？"''“”‘’/|]+'), lambda t: len(t) >= 2)) AS qt
      FROM v WHERE conv_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
vl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {SQL_SCORE['cosine']} AS s FROM q, (SELECT chunk_id, embedding FROM v)) QUALIFY rank <= {3 * TOP}),
qw AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS mean FROM (SELECT file_id, max(doc_length)::DOUBLE AS l FROM posts GROUP BY file_id)),
dfs AS (SELECT term, count(DISTINCT file_id)::DOUBLE AS df FROM posts GROUP BY term),
ks AS (SELECT query_id, chunk_id, sum(qn * ln((st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / st.mean))) AS s FROM posts JOIN qw USING (term) JOIN dfs USING (term), st GROUP BY ALL),
kl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM ks QUALIFY rank <= {3 * TOP}),
ls AS ({chosen}),
fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, list(ln ORDER BY li) AS sources, min(li * 1000000 + rank) AS tie FROM ls GROUP BY ALL),
it AS (SELECT o.*, c.file_id, c.content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, tie) AS ord FROM fused) o JOIN chunks c USING (chunk_id)),
g AS (SELECT query_id, file_id, sum(score) AS total, first(score ORDER BY ord) AS rep, count(*) AS chunk_hits, min(ord) AS ord, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM it GROUP BY query_id, file_id),
f AS (SELECT *, rep + greatest(0, total - rep) * 0.35::DOUBLE AS fs FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rep + greatest(0, total - rep) * 0.35::DOUBLE, 9) DESC, ord) <= {TOP}),
b AS (SELECT it.query_id, it.file_id, it.chunk_id, it.score, it.ord, fs, chunk_hits, f.sources, {bonus} AS bonus FROM it JOIN f ON it.query_id = f.query_id AND it.file_id = f.file_id JOIN q ON q.query_id = it.query_id),
pick AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY round(bonus, 9) DESC, round(score, 9) DESC, ord) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fs + bonus, 9) DESC, chunk_id) AS INTEGER) AS rank, file_id, chunk_id, round(fs + bonus, 6) AS score, chunk_hits, array_to_string(sources, ',') AS sources FROM pick"""


@query(sql_many("hybrid"))
def hybrid_many(spark, d):
    """Many hybrid queries over conversations, files of many chunks, so that grouping and the choice of chunks decide."""
    out = retrieval.search_many(*_many(spark, d), TOP)
    return out.select("query_id", "rank", "file_id", "chunk_id", F.round("score", 6).alias("score"), "chunk_hits", F.array_join("sources", ",").alias("sources"))


def sql_compare(method: str) -> str:
    return f"""SELECT '{method}' AS method, count(*) AS queries, round(avg(coalesce(hit, 0) / {TOP}.0), 6) AS precision_at_k, round(avg(coalesce(hit / returned, 0)), 6) AS precision_returned, round(avg(coalesce(hit, 0)), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr
FROM (SELECT DISTINCT conv_id AS query_id FROM conversations WHERE conv_id % 50 = 0) LEFT JOIN
(SELECT query_id, count(*)::DOUBLE AS returned, count_if(file_id = CAST(query_id AS VARCHAR))::DOUBLE AS hit, min(CASE WHEN file_id = CAST(query_id AS VARCHAR) THEN rank END)::DOUBLE AS first FROM ({sql_many(method)}) GROUP BY query_id) USING (query_id)"""


@query(" UNION ALL ".join(f"({sql_compare(m)})" for m in ("vector", "keyword", "hybrid")))
def eval_methods(spark, d):
    """Vector, keyword and hybrid search compared: a conversation's first turn should find its own conversation."""
    chunks, postings, vecs, queries = _many(spark, d)
    expected = read(spark, d, "conversations").where("conv_id % 50 = 0").select(F.col("conv_id").alias("query_id"), F.col("conv_id").cast("string").alias("id")).distinct()
    rows = retrieval.compare(chunks, postings, vecs, queries, expected, TOP)
    return rows.select("method", "queries", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "precision_returned", "recall_at_k", "mrr")])


def said(path: str, kind: str, name: str, rows: str) -> str:
    return f"SELECT {path} AS relative_path, count(*) || ' entries. ' || substr(string_agg('{kind} ' || {name} || ': ' || s, ' ' ORDER BY {name} || ': ' || s), 1, 400) AS s FROM {rows} GROUP BY 1"


@query(f"""WITH f AS (SELECT source, lang, CAST(doc_id AS VARCHAR) AS name, CAST(n_chars AS VARCHAR) AS s FROM documents),
a AS ({said("source || '/' || lang", "file", "name", "f")}), b AS ({said("split_part(relative_path, '/', 1)", "directory", "split_part(relative_path, '/', 2)", "a")}),
c AS ({said("'.'", "directory", "relative_path", "b")})
SELECT relative_path, s AS summary FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def directory_summaries(spark, d):
    """Summaries of directories (source, language) from their files' and their own directories', deepest first."""
    files = read(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("string").alias("summary"))
    dirs = tree.directories(files.select(F.lit("p").alias("project_id"), "path"))
    return summaries.fold(dirs, files, summaries.extract()).select("relative_path", "summary")


@query(f"WITH {sql_bm25(CONV, TERMS)} SELECT file_id, chunk_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, chunk_id LIMIT 25")
def sql_search(spark, d):
    """The table function search, from SQL text."""
    chunks = conversations_as_chunks(spark, d)
    table_functions.register(spark, cut(P.build(chunks)), P.lengths(chunks), "search_conversations")
    return spark.sql(f"SELECT file_id, chunk_id, round(score, 6) AS score FROM search_conversations('{' '.join(TERMS)} the a', 25)")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, line_no::INT AS line_no, line, array_to_string(ls[greatest(1, line_no - 1) : line_no - 1], '|') AS before, array_to_string(ls[line_no + 1 : line_no + 1], '|') AS after FROM l WHERE contains(lower(line), 'license')""")
def sql_grep(spark, d):
    """The table function grep, from SQL text."""
    table_functions.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("grepped_documents")
    return spark.sql("SELECT doc_id, line_no, line, array_join(before, '|') AS before, array_join(after, '|') AS after FROM grep(TABLE(SELECT doc_id, text AS content FROM grepped_documents), 'License', false, 1)")


@query("SELECT doc_id, lang, array_to_string((string_split(text, chr(10)))[least(2, len(string_split(text, chr(10)))) : greatest(2, least(4, len(string_split(text, chr(10)))))], chr(10)) AS content, len(string_split(text, chr(10)))::INT AS total_lines FROM documents")
def sql_read_lines(spark, d):
    """The table function read_lines, from SQL text."""
    table_functions.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("read_documents")
    return spark.sql("SELECT * FROM read_lines(TABLE(SELECT doc_id, lang, text AS content FROM read_documents), 2, 4)")


@query("""SELECT 'd' || (conv_id % 7) || '/' || conv_id || '.md' AS path, 'md' AS type, CASE WHEN bool_and(turn % 9 <> 0) THEN 'indexed' ELSE 'embedding' END AS status, count(*)::INT AS chunk_count, sum(strlen(text))::BIGINT AS size
FROM conversations GROUP BY conv_id""")
def import_commit(spark, d):
    """Conversations as ready chunks, some without vectors, committed to a new catalog: its files."""
    c = read(spark, d, "conversations")
    vector = F.when(F.col("turn") % 9 != 0, F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    rows = c.select(F.concat(F.lit("d"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.col("turn").cast("int").alias("idx"), F.col("text").alias("content"), F.lit("").alias("locator"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), vector.alias("content_vector"), F.lit("h").alias("hash"))
    catalog = Catalog(spark, f"{folder(spark)}/catalog-{uuid.uuid4().hex}")
    indexing.import_rows(catalog, "p", rows)
    return catalog.read("files").select("path", "type", "status", "chunk_count", "size")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations),
f AS (SELECT conv_id, turn, i, w[i + 1] AS t, 800 - 12 * (i // 8) - (i % 3) * 0.75 AS y, i % 29 = 0 AS eol FROM (SELECT *, unnest(range(0, len(w))) AS i FROM w)),
b AS (SELECT *, (coalesce(abs(y - lag(y) OVER p) > 4, false) OR coalesce(lag(eol) OVER p, false))::INT AS begins FROM f WINDOW p AS (PARTITION BY conv_id, turn ORDER BY i)),
l AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id, turn ORDER BY i) AS line FROM b),
j AS (SELECT conv_id, turn, line, string_agg(t, ' ' ORDER BY i) AS t FROM l GROUP BY ALL)
SELECT conv_id, turn, string_agg(t, chr(10) ORDER BY line) AS content FROM j GROUP BY ALL""")
def assembled_lines(spark, d):
    """Lines of positioned fragments: every word of a turn at a place, eight words a line, some ends of lines marked."""
    words = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).alias("seq", "text"))
    y = 800 - 12 * F.floor(F.col("seq") / 8) - (F.col("seq") % 3) * 0.75
    placed = words.withColumns({"x": (F.col("seq") % 8) * 40.0, "y": y.cast("double"), "eol": F.col("seq") % 29 == 0})
    return pages.assemble(placed, "conv_id", "turn")


@query()
def collated_names(spark, d):
    """Names and their places in the order of a language, not of bytes: accents and cases stand beside their letters."""
    names = read(spark, d, "nation").select(F.explode(F.array(F.initcap("n_name"), F.lower("n_name"), F.translate("n_name", "AEIOU", "ÄÉÎÖÜ"))).alias("name"))
    return tree.by_name(names.distinct(), "name")
