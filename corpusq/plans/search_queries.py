"""Registered queries: tokens, postings, BM25, nearest neighbours, fusion, composite search; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions.text import LIBRARY_STOP_WORDS, STOP_WORDS, tokens
from corpusq.operators import bm25, fusion, vectors
from corpusq.operators import postings as P
from corpusq.plans import retrieval
from corpusq.sources.tables import conversations_as_chunks, documents_as_chunks, read

TERMS = ["thtion", "erble", "nicht", "thing"]
DOC_TERMS = ["thatin", "attion", "ononst", "ertion"]
DIRS = ["dir1", "dir3"]
SOURCES = ["src0", "src3", "src7"]

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _stop(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_tokens(column: str, style: str = "index") -> str:
    if style == "cloud":
        return f"list_filter(string_split_regex(lower({column}), '\\s+'), lambda t: t <> '')"
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: NOT regexp_full_match(t, '[a-z0-9]') AND t NOT IN ({_stop(LIBRARY_STOP_WORDS if style == 'library' else STOP_WORDS)}))"


CONV = "chunks AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, 'dir' || (conv_id % 5) AS dir_id, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS chunk_id, CAST(turn AS INT) AS idx, role, text AS content FROM conversations)"
DOCS = "chunks AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS dir_id, CAST(doc_id AS VARCHAR) AS chunk_id, text AS content FROM documents)"


def sql_postings(chunks: str, style: str = "index") -> str:
    return f"""{chunks},
toks AS (SELECT file_id, dir_id, chunk_id, {sql_tokens('content', style)} AS w FROM chunks),
flat AS (SELECT file_id, dir_id, chunk_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM toks),
len AS (SELECT file_id, sum(len(w))::BIGINT AS doc_length FROM toks GROUP BY file_id),
posts AS (SELECT term, file_id, dir_id, chunk_id, count(*) AS tf, list(pos ORDER BY pos) AS positions, any_value(doc_length) AS doc_length FROM flat JOIN len USING (file_id) GROUP BY term, file_id, dir_id, chunk_id)"""


def sql_bm25(chunks: str, terms: list[str], profile: str = "local", dirs: list[str] | None = None, name: str = "bm") -> str:
    style = {"local": "index"}.get(profile, profile)
    weights = bm25.query_weights(terms, profile)
    values = ", ".join(f"('{t}', {n})" for t, n in weights.items())
    unit = "chunk_id" if profile == "library" else "file_id"
    where = f"WHERE dir_id IN ({', '.join(repr(d) for d in dirs)})" if dirs else ""
    k1, b = (1.2, 0.0) if profile == "cloud" else (1.5, 0.75)
    length = "clen.n" if profile == "library" else "doc_length"
    return f"""{sql_postings(chunks, style)},
scoped AS (SELECT * FROM posts {where}), q(term, qn) AS (VALUES {values}),
clen AS (SELECT chunk_id, sum(tf)::DOUBLE AS n FROM scoped GROUP BY chunk_id),
units AS (SELECT {unit} AS u, {"sum(tf)" if profile == "library" else "max(doc_length)"}::DOUBLE AS n FROM scoped GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(n) AS mean FROM units),
dfs AS (SELECT term, count(DISTINCT {unit})::DOUBLE AS df FROM scoped JOIN q USING (term) GROUP BY term),
{name} AS (SELECT file_id, scoped.chunk_id, sum(qn * ln((st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * {length} / st.mean))) AS score
      FROM scoped JOIN q USING (term) JOIN dfs USING (term) JOIN clen ON clen.chunk_id = scoped.chunk_id, st GROUP BY file_id, scoped.chunk_id HAVING score > 0)"""


@query(f"WITH {CONV} SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({sql_tokens('content')}) AS term FROM chunks) GROUP BY chunk_id, term")
def term_frequency(spark, d):
    return P.term_frequency(conversations_as_chunks(spark, d))


@query(f"WITH {sql_postings(CONV)} SELECT term, file_id, dir_id, chunk_id, tf, array_to_string(positions, ',') AS positions, doc_length FROM posts")
def postings_build(spark, d):
    return P.build(conversations_as_chunks(spark, d)).select("term", "file_id", "dir_id", "chunk_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "doc_length")


@query(f"WITH {sql_postings(CONV)} SELECT term, file_id, sum(tf)::BIGINT AS tf_sum, count(DISTINCT chunk_id) AS chunk_count, max(doc_length) AS doc_length FROM posts GROUP BY term, file_id")
def postings_per_file(spark, d):
    return P.per_file(P.build(conversations_as_chunks(spark, d)))


@query(f"WITH {sql_postings(CONV)} SELECT term, count(DISTINCT file_id) AS df FROM posts GROUP BY term")
def doc_freq(spark, d):
    return P.document_frequency(P.build(conversations_as_chunks(spark, d)))


@query(f"WITH {sql_postings(CONV, 'library')} SELECT term, count(DISTINCT chunk_id) AS df FROM posts GROUP BY term")
def chunk_doc_freq(spark, d):
    return P.document_frequency(P.build(conversations_as_chunks(spark, d), "library"), "chunk_id")


@query(f"WITH {sql_postings(CONV)} SELECT dir_id, count(*) AS total_docs, round(avg(n), 6) AS avg_doc_length FROM (SELECT dir_id, file_id, max(doc_length) AS n FROM posts GROUP BY dir_id, file_id) GROUP BY dir_id")
def dir_stats(spark, d):
    return P.dir_stats(P.build(conversations_as_chunks(spark, d))).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(f"WITH {sql_postings(CONV, 'cloud')} SELECT dir_id, count(*) AS total_docs, round(avg(n), 6) AS avg_doc_length FROM (SELECT dir_id, file_id, sum(tf) AS n FROM posts GROUP BY dir_id, file_id) GROUP BY dir_id")
def cloud_dir_stats(spark, d):
    return P.cloud_dir_stats(P.build(conversations_as_chunks(spark, d), "cloud")).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(f"WITH {sql_postings(CONV)}, s AS (SELECT dir_id, count(*) AS n, avg(l) AS a FROM (SELECT dir_id, file_id, max(doc_length) AS l FROM posts GROUP BY dir_id, file_id) GROUP BY dir_id) SELECT sum(n)::BIGINT AS total_docs, round(sum(n * a) / sum(n), 6) AS avg_doc_length FROM s WHERE dir_id IN ('dir1', 'dir3')")
def scope_stats(spark, d):
    return P.scope_stats(P.dir_stats(P.build(conversations_as_chunks(spark, d))), DIRS).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


def _bm25(spark, d, terms, profile="local", dirs=None):
    style = "index" if profile == "local" else profile
    chunks = conversations_as_chunks(spark, d)
    sizes = P.lengths(chunks, style, "chunk_id" if profile == "library" else "file_id")
    return bm25.search(P.build(chunks, style), terms, profile, dirs, lengths=sizes).withColumn("score", F.round("score", 6))


def sql_bm25_rows(*args) -> str:
    return f"WITH {sql_bm25(CONV, *args)} SELECT file_id, chunk_id, round(score, 6) AS score FROM bm"


@query(sql_bm25_rows(TERMS))
def bm25_local(spark, d):
    return _bm25(spark, d, TERMS)


@query(sql_bm25_rows(TERMS, "library"))
def bm25_library(spark, d):
    return _bm25(spark, d, TERMS, "library")


@query(sql_bm25_rows([*TERMS, "thing"], "cloud"))
def bm25_cloud(spark, d):
    return _bm25(spark, d, [*TERMS, "thing"], "cloud")


@query(sql_bm25_rows([*TERMS, "thing", "thing"]))
def bm25_dup_terms(spark, d):
    return _bm25(spark, d, [*TERMS, "thing", "thing"])


@query(sql_bm25_rows(TERMS, "local", DIRS))
def bm25_scoped(spark, d):
    return _bm25(spark, d, TERMS, dirs=DIRS)


def sql_doc_bm25_top(k: int) -> str:
    return f"WITH {sql_bm25(DOCS, DOC_TERMS)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, chunk_id LIMIT {k}"


@query(sql_doc_bm25_top(20))
def bm25_top_documents(spark, d):
    chunks = documents_as_chunks(spark, d)
    return bm25.search(P.build(chunks), DOC_TERMS, top_k=20, lengths=P.lengths(chunks)).select("chunk_id", F.round("score", 6).alias("score"))


BENCH_TOKENS = f"q AS (SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark), qw AS (SELECT query_id, term, count(*) AS qn FROM q GROUP BY ALL)"


@query(f"""WITH {sql_postings(CONV)}, {BENCH_TOKENS}, st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS mean FROM (SELECT file_id, max(doc_length)::DOUBLE AS l FROM posts GROUP BY file_id)),
dfs AS (SELECT term, count(DISTINCT file_id)::DOUBLE AS df FROM posts GROUP BY term),
s AS (SELECT query_id, file_id, chunk_id, sum(qn * ln((st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / st.mean))) AS score FROM posts JOIN qw USING (term) JOIN dfs USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, file_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def bm25_batch(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return bm25.search_many(P.build(conversations_as_chunks(spark, d)), q, 10).select("query_id", "file_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vector(spark, d, i=0):
    return list(read(spark, d, "embeddings").where(F.col("vec_id") == i).first().embedding)


Q0 = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
SQL_SCORE = {
    "cosine": "1 - (1 - list_cosine_similarity(embedding::DOUBLE[], q)) / 2",
    "cloud": "list_cosine_similarity(embedding::DOUBLE[], q)",
    "l2": "1 / (1 + list_distance(embedding::DOUBLE[], q))",
    "dot": "list_inner_product(embedding::DOUBLE[], q)",
}


def sql_knn(kind: str, k: int, where: str = "true") -> str:
    return f"WITH {Q0} SELECT vec_id, label, round(s, 6) AS score FROM (SELECT vec_id, label, {SQL_SCORE[kind]} AS s FROM embeddings, qv WHERE {where}) ORDER BY round(s, 9) DESC, vec_id LIMIT {k}"


def _knn(spark, d, k, metric, profile="local", where=None):
    return vectors.knn(read(spark, d, "embeddings"), _vector(spark, d), k, metric, profile, where).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(sql_knn("cosine", 20))
def knn_cosine(spark, d):
    return _knn(spark, d, 20, "cosine")


@query(sql_knn("cloud", 20))
def knn_cosine_cloud(spark, d):
    return _knn(spark, d, 20, "cosine", "cloud")


@query(sql_knn("l2", 20))
def knn_l2(spark, d):
    return _knn(spark, d, 20, "l2")


@query(sql_knn("dot", 20))
def knn_dot(spark, d):
    return _knn(spark, d, 20, "dot")


@query(sql_knn("cosine", 15, "label IN (2, 5)"))
def knn_scoped(spark, d):
    return _knn(spark, d, 15, "cosine", where=F.col("label").isin(2, 5))


@query(f"""WITH {Q0}, s AS (SELECT vec_id, label, {SQL_SCORE['cosine']} AS s FROM embeddings, qv),
top AS (SELECT * FROM (SELECT * FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 20) WHERE label IN (2, 5)),
alt AS (SELECT * FROM s WHERE label IN (2, 5) ORDER BY round(s, 9) DESC, vec_id LIMIT 20),
u AS (SELECT * FROM top WHERE (SELECT count(*) FROM top) >= 10 UNION ALL SELECT * FROM alt WHERE (SELECT count(*) FROM top) < 10)
SELECT vec_id, label, round(s, 6) AS score FROM u ORDER BY round(s, 9) DESC, vec_id LIMIT 10""")
def knn_postfilter_compat(spark, d):
    return vectors.knn_post_filter(read(spark, d, "embeddings"), _vector(spark, d), 10, F.col("label").isin(2, 5)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""")
def knn_batch(spark, d):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.knn_many(e, q, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(vectors.clean(F.col("embedding"))), 6).alias("norm"))


def sql_lists(k: int, cosine: str = "cosine", profile: str = "local", dirs: list[str] | None = None) -> str:
    where = f"WHERE dir_id IN ({', '.join(repr(x) for x in dirs)})" if dirs else ""
    return f"""{sql_bm25(DOCS, DOC_TERMS, profile, dirs)}, {Q0},
vl AS (SELECT chunk_id, row_number() OVER (ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM (SELECT c.chunk_id, {SQL_SCORE[cosine]} AS s FROM embeddings e JOIN chunks c ON c.chunk_id = CAST(e.vec_id AS VARCHAR), qv {where}) QUALIFY rank <= {k}),
kl AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= {k}),
ls AS (SELECT chunk_id, 0 AS li, 'vector' AS ln, rank FROM vl UNION ALL SELECT chunk_id, 1, 'keyword', rank FROM kl),
fused AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, list(ln ORDER BY li) AS sources, min(li * 1000000 + rank) AS tie FROM ls GROUP BY chunk_id),
ord AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, tie) AS ord FROM fused)"""


def _parts(spark, d, style="index"):
    chunks = documents_as_chunks(spark, d)
    vecs = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding").join(chunks.select("chunk_id", "dir_id"), "chunk_id")
    return chunks, P.build(chunks, style), vecs, P.lengths(chunks, style, "chunk_id" if style == "library" else "file_id")


def _fused(spark, d, k, profile="local", dirs=None):
    chunks, postings, vecs, sizes = _parts(spark, d, "index" if profile == "local" else profile)
    near, words = retrieval.lists(chunks, postings, vecs, _vector(spark, d), DOC_TERMS, k, profile, dirs, sizes)
    return retrieval.fuse(near, words)


@query(f"WITH {sql_lists(30)} SELECT chunk_id, round(score, 9) AS score, array_to_string(sources, ',') AS sources FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d, 30).select("chunk_id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {sql_lists(20, 'cosine', 'local', SOURCES)} SELECT array_to_string(sources, ',') AS sources, count(*) AS n FROM fused GROUP BY 1")
def rrf_sources(spark, d):
    return _fused(spark, d, 20, dirs=SOURCES).groupBy(F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"))


@query(f"""WITH {sql_lists(30)} SELECT coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank FROM vl v FULL OUTER JOIN kl k ON v.chunk_id = k.chunk_id""")
def fusion_full_outer(spark, d):
    chunks, postings, vecs, sizes = _parts(spark, d)
    near, words = retrieval.lists(chunks, postings, vecs, _vector(spark, d), DOC_TERMS, 30, "local", None, sizes)
    v = fusion.ranked(near, "vector", 0, "chunk_id").select(F.col("id").alias("chunk_id"), F.col("rank").alias("vector_rank"))
    k = fusion.ranked(words, "keyword", 1, "chunk_id").select(F.col("id").alias("chunk_id"), F.col("rank").alias("keyword_rank"))
    return v.join(k, "chunk_id", "full_outer")


CONV_ITEMS = f"{sql_bm25(CONV, TERMS)}, items AS (SELECT chunk_id, file_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS ord FROM bm)"
GROUPED = """g AS (SELECT file_id, sum(score) AS total, max(score) AS rep, first(chunk_id ORDER BY ord) AS chunk_id, count(*) AS chunk_hits, string_agg(chunk_id, ',' ORDER BY ord) AS chunk_ids, min(ord) AS ord FROM items GROUP BY file_id)"""


def _items(spark, d):
    hits = bm25.search(P.build(conversations_as_chunks(spark, d)), TERMS)
    return hits.select("chunk_id", F.col("file_id").alias("file_key"), "score", fusion.place(F.col("score"), F.col("chunk_id")).alias("ord"), F.array(F.lit("keyword")).alias("sources"))


@query(f"WITH {CONV_ITEMS}, {GROUPED} SELECT file_id AS file_key, chunk_id, round(rep + greatest(0, total - rep) * 0.35::DOUBLE, 6) AS score, chunk_hits, chunk_ids FROM g ORDER BY round(rep + greatest(0, total - rep) * 0.35::DOUBLE, 9) DESC, ord LIMIT 25")
def group_by_file_boost(spark, d):
    return fusion.group_by_file(_items(spark, d), top_k=25).select("file_key", "chunk_id", F.round("score", 6).alias("score"), "chunk_hits", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {CONV_ITEMS}, {GROUPED} SELECT file_id AS file_key, chunk_id FROM g")
def file_representative(spark, d):
    return fusion.group_by_file(_items(spark, d), 0.0).select("file_key", "chunk_id")


@query(f"""WITH {CONV_ITEMS}, {GROUPED}, top AS (SELECT file_id FROM g ORDER BY round(rep + greatest(0, total - rep) * 0.35::DOUBLE, 9) DESC, ord LIMIT 25),
h AS (SELECT items.*, c.content, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS n FROM items JOIN top USING (file_id) JOIN (SELECT chunk_id, content FROM chunks) c USING (chunk_id)),
t AS (SELECT * REPLACE (regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content) FROM h WHERE n <= 3),
p AS (SELECT *, CASE WHEN strpos(content, 'thing, attion') > 0 THEN strpos(content, 'thing, attion') WHEN strpos(content, 'thing') > 0 THEN strpos(content, 'thing') ELSE strpos(content, 'attion') END AS spot FROM t)
SELECT file_id AS file_key, chunk_id, n, CASE WHEN content = '' THEN '' WHEN spot > 0 THEN (CASE WHEN spot > 25 THEN '...' ELSE '' END) || substr(content, greatest(spot - 24, 1), least(spot + 12 + 24, length(content)) - greatest(spot - 24, 1) + 1) || (CASE WHEN spot + 36 < length(content) THEN '...' ELSE '' END) ELSE substr(content, 1, 48) END AS snippet FROM p""")
def keyword_snippets(spark, d):
    from corpusq.functions.text import snippet

    items = _items(spark, d)
    hits = items.select("file_key", "chunk_id", F.col("ord").alias("rank"))
    found = fusion.snippets(fusion.group_by_file(items, top_k=25), hits)
    chunks = conversations_as_chunks(spark, d).select("chunk_id", "content")
    return found.join(chunks, "chunk_id").select("file_key", "chunk_id", "n", snippet(F.col("content"), F.lit("thing, attion")).alias("snippet"))


def sql_count(where: str, terms) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({where}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")"


def sql_bonus(terms, phrases, snippet_sql: str) -> str:
    head = "array_to_string(list_filter(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1:4], lambda x, i: i <= 2 OR regexp_matches(x, '^\\s*#{1,6}\\s')), chr(10))"
    lead = "substr(content, 1, 200)"
    ps = " + ".join(f"CASE WHEN contains(content, '{p}') THEN 0.008::DOUBLE ELSE 0 END + CASE WHEN contains({lead}, '{p}') THEN 0.012::DOUBLE ELSE 0 END + CASE WHEN contains({head}, '{p}') THEN 0.016::DOUBLE ELSE 0 END" for p in phrases)
    return f"CASE WHEN {snippet_sql} THEN 0.02::DOUBLE ELSE 0 END + {ps} + least({sql_count(head, terms)}, 3) * 0.004::DOUBLE + least({sql_count(lead, terms)}, 4) * 0.002::DOUBLE + CASE WHEN {sql_count(head, terms)} > 0 AND regexp_matches({head}, '(?m)^\\s*#{{1,6}}\\s') THEN 0.006::DOUBLE ELSE 0 END"


@query(f"WITH {CONV} SELECT chunk_id, round({sql_bonus(['thing', 'erble'], ['thing', 'the thing'], 'idx % 2 = 0')}, 6) AS bonus FROM chunks")
def representative_bonus(spark, d):
    c = conversations_as_chunks(spark, d)
    return c.select("chunk_id", F.round(fusion.bonus(F.col("content"), F.col("idx") % 2 == 0, ["thing", "the thing"], ["thing", "erble"]), 6).alias("bonus"))


@query(f"""WITH {sql_lists(30)}, it AS (SELECT o.*, c.file_id, c.content, kl.chunk_id IS NOT NULL AS hit FROM ord o JOIN chunks c USING (chunk_id) LEFT JOIN kl USING (chunk_id)),
g AS (SELECT file_id, score, ord FROM it ORDER BY round(score, 9) DESC, ord LIMIT 10)
SELECT it.file_id, it.chunk_id, round(it.score + {sql_bonus(['attion', 'thing'], ['attion', 'attion thing'], 'hit')}, 6) AS score, len(content) AS n_chars FROM it JOIN g USING (file_id)""")
def hybrid_search_local(spark, d):
    chunks, postings, vecs, sizes = _parts(spark, d)
    out = retrieval.search(chunks, postings, vecs, _vector(spark, d), "attion thing", DOC_TERMS, 10, keyword="attion", lengths=sizes)
    return out.select("file_id", "chunk_id", F.round("score", 6).alias("score"), F.length("content").alias("n_chars"))


@query(f"""WITH {sql_lists(20, 'cosine', 'library')} SELECT c.file_id, o.chunk_id, round(score, 6) AS score, array_to_string(sources, ',') AS sources FROM ord o JOIN chunks c USING (chunk_id) WHERE ord <= 10""")
def hybrid_search_library(spark, d):
    chunks, postings, vecs, sizes = _parts(spark, d, "library")
    out = retrieval.search(chunks, postings, vecs, _vector(spark, d), "", DOC_TERMS, 10, "library", lengths=sizes)
    return out.select("file_id", "chunk_id", F.round("score", 6).alias("score"), F.reverse("sources").alias("s")).select("file_id", "chunk_id", "score", F.array_join("s", ",").alias("sources"))


@query(f"""WITH {sql_lists(20, 'cloud', 'cloud')} SELECT c.file_id, o.chunk_id, round(score, 6) AS score, array_to_string(sources, ',') AS sources FROM ord o JOIN chunks c USING (chunk_id) JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.file_id WHERE ord <= 10 AND l.quality = 1""")
def hybrid_search_cloud(spark, d):
    chunks, postings, vecs, sizes = _parts(spark, d, "cloud")
    status = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("file_id"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("status"))
    out = retrieval.search(chunks, postings, vecs, _vector(spark, d), "", DOC_TERMS, 10, "cloud", status=status, lengths=sizes)
    return out.select("file_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))
