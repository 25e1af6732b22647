"""Ranked lexical search by TPUT over term-partitioned postings.

Terms are the maximal runs of digits, letters A-Z and a-z and everything beyond ASCII, A-Z lower-cased.  A term's part of
a document's score is w * ((10^9 tf) div (1000 tf + 8 m)) with w = floor(1000 ln((2N + 2) / (2df + 1))) and
m = 10 + ((90 n N) div L), all whole numbers but w's logarithm, so sums do not depend on their order.

``forward`` counts every document's terms within its row, in Python over Arrow batches, and keeps those that a query
has; lengths and N cover all documents.  ``lists`` turns them into postings (term, document, score): one range shuffle
by term, falling score and document writes impact-ordered lists, of which a hot one spans as many partitions as it needs.
``search`` is TPUT, three rounds for all queries together:

1. heads: the k highest of every list give each query documents to look up; the k-th highest of their scores, s1, bounds
   the query's k-th score from below (0 while fewer than k documents are seen);
2. a threshold for the query's lists.  As many lists as have heads that together stay below s1 are left unread; what is left
   of s1 is the uniform threshold of all others, shared by their number, and every posting of theirs above it is fetched.  A
   document without one has less than s1.  The sums may raise the bound to s2, and documents stay whose sum, with the
   threshold or the head for each list in which they were not seen, reaches s2;
3. their exact scores are looked up by document.

Nothing is cut without this bound, so results are exact.  Queries without any term give no rows; k-th places are found by
``row_number`` limits, which Spark applies before its shuffle.

Which terms queries have is sent to the tasks if they are at most ``TERMS`` terms and ``BYTES`` bytes; beyond, all terms
are kept and joined with the queries' by shuffle.

Defined cases: a null or empty text has no term, is not counted in N and never found; a null or empty query gives no row;
rows of equal or null doc_id are documents of their own, and equal scores go by doc_id (null last), then by row; every row
of queries is a query, whatever its item_id; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import cut, drop, lower_ascii, prepare

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Most terms, and bytes of terms, that are sent to all tasks.
TERMS, BYTES = 1 << 20, 1 << 24
#: Most terms, summed over the queries, that are sent to all tasks for the last round.
PAIRS = 1 << 18
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
#: A-Z to a-z, and a space for each byte that no term has.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))


def counted(text: str | None) -> Counter:
    """How often each term occurs, as bytes."""
    out: Counter = Counter()
    raw = (text or "").encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _count(sent):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted = None if sent is None else sent.value
        for batch in batches:
            n, sizes, terms, tf = [], [0], [], []
            for text in batch.column("text"):
                c = counted(text.as_py())
                n.append(c.total())
                keys = list(c if wanted is None else c.keys() & wanted)
                terms += keys
                tf += map(c.__getitem__, keys)
                sizes.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
            lists_ = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64()), lists_], ["uid", "doc_id", "n", "terms"])

    return run


def wants(queries: DataFrame) -> DataFrame:
    """(query, item_id, term): each query's terms, once each; written, so that the numbers of queries stay."""
    q = queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    return cut(q.select("query", "item_id", F.explode("terms").alias("term")))


def forward(documents: DataFrame, terms: DataFrame | None = None, most: int = TERMS) -> DataFrame:
    """(uid, doc_id, n, terms): the number of a document's terms, and the distinct ones that ``terms`` (term) has, with counts."""
    spark = prepare(documents.sparkSession)
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sent = None
    if terms is not None:
        few = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).head()
        if few.n <= most and few.b <= BYTES:
            sent = spark.sparkContext.broadcast({r.term.encode("utf-8") for r in terms.select("term").toLocalIterator()})
    return docs.mapInArrow(_count(sent), "uid bigint, doc_id bigint, n bigint, terms array<struct<term: string, tf: bigint>>")


def scored(rows: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Column score for (n, tf, w); whole numbers only."""
    count, length = (F.lit(x).cast("decimal(20,0)") for x in size)
    m = F.expr("10 + ((CAST(90 * n AS DECIMAL(18,0)) * __n) div __l)")
    rows = rows.withColumns({"__n": count, "__l": length}).withColumn("__m", m)
    return rows.withColumn("score", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * __m))")).drop("__n", "__l", "__m", "w")


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and all their terms with repeats."""
    r = docs.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).head()
    return r.n, r.l


def weights(docs: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """(term, w) of the terms that some document has."""
    df = docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi")
    return df.select("term", F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("w"))


def lists(docs: DataFrame, weights_: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(term, uid, score) with scores above 0, by term and falling score."""
    rows = docs.select("uid", "n", F.explode("terms").alias("t")).select("uid", "n", "t.term", "t.tf")
    order = [F.col("term"), F.col("score").desc(), F.col("uid")]
    return scored(rows.join(weights_, "term"), size).where("score > 0").select("term", "uid", "score").repartitionByRange(*order).sortWithinPartitions(*order)


def highest(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def bound(sums: DataFrame, k: int) -> DataFrame:
    """(query, least): the k-th highest sum, or 0 for fewer."""
    top = highest(sums, k, F.col("sum").desc(), F.col("uid"))
    return top.groupBy("query").agg(F.when(F.count("*") == k, F.min("sum")).otherwise(0).alias("least"))


def lookup(docs: DataFrame, pairs: DataFrame, want: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(query, uid, doc_id, score) of pairs(query, uid): whole scores."""
    rows = docs.join(pairs, "uid").select("query", "uid", "doc_id", "n", F.explode("terms").alias("t")).select("query", "uid", "doc_id", "n", "t.term", "t.tf")
    return scored(rows.join(want.select("query", "term", "w"), ["query", "term"]), size).groupBy("query", "uid", "doc_id").agg(F.sum("score").alias("score"))


def _best(sent, k: int):
    """For rows (uid, doc_id, n, terms, queries): the k best scores of each query in a batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        numbers, index, (count, length) = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists_, asked = batch.column("terms"), batch.column("queries")
            pairs = lists_.flatten()
            terms, tf = pairs.field(0).to_pylist(), pairs.field(1).to_numpy()
            at, of = np.concatenate([[0], np.cumsum(lists_.value_lengths())]), np.concatenate([[0], np.cumsum(asked.value_lengths())])
            wanted = np.searchsorted(numbers, asked.flatten().to_numpy())
            score = np.zeros(len(wanted), np.int64)
            for i, n in enumerate(batch.column("n").to_pylist()):
                known = [(j, *index[t]) for j, t in enumerate(terms[at[i] : at[i + 1]], int(at[i])) if t in index]
                if known:
                    places, w, queries = zip(*known)
                    f = tf[list(places)]
                    part = np.array(w) * (10**9 * f // (1000 * f + 8 * (10 + 90 * n * count // length)))
                    # Whole numbers below 2^53, so sums in floating point are exact.
                    sums = np.bincount(np.concatenate(queries), np.repeat(part, [len(q) for q in queries]), len(numbers))
                    score[of[i] : of[i + 1]] = sums[wanted[of[i] : of[i + 1]]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(of))
            ids = batch.column("doc_id")
            none, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            order = np.lexsort((batch.column("uid").to_numpy()[row], value[row], none[row], -score, wanted))
            order = order[score[order] > 0]
            first = np.searchsorted(wanted[order], wanted[order])
            order = order[np.arange(len(order)) - first < k]
            take = pa.array(row[order])
            yield pa.RecordBatch.from_arrays([pa.array(numbers[wanted[order]]), batch.column("uid").take(take), ids.take(take), pa.array(score[order])], ["query", "uid", "doc_id", "score"])

    return run


def best(docs: DataFrame, found: DataFrame, want: DataFrame, size: tuple[int, int], k: int, most: int = PAIRS) -> DataFrame:
    """(query, uid, doc_id, score, rank): each query's k best of found(query, uid), by their whole scores.

    With at most ``most`` terms of queries, these are sent to the tasks, which score a document for all queries that found it
    and pass on k rows a query and batch; beyond, terms are joined.
    """
    rows = want.select("query", "term", "w").limit(most + 1).collect()
    if len(rows) > most:
        scores = lookup(docs, found, want, size).where("score > 0")
    elif not rows:
        scores = lookup(docs, found, want, size)
    else:
        import numpy as np

        numbers = np.array(sorted({r["query"] for r in rows}), np.int64)
        place, index = {q: i for i, q in enumerate(numbers.tolist())}, {}
        for r in rows:
            index.setdefault(r.term, (r.w, []))[1].append(place[r["query"]])
        sent = docs.sparkSession.sparkContext.broadcast((numbers, {t: (w, np.array(q)) for t, (w, q) in index.items()}, size))
        asked = docs.join(found.groupBy("uid").agg(F.collect_list("query").alias("queries")), "uid")
        scores = asked.select("uid", "doc_id", "n", "terms", "queries").mapInArrow(_best(sent, k), "query bigint, uid bigint, doc_id bigint, score bigint")
    return highest(scores, k, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid"))


def level(want: DataFrame, tops: DataFrame, first: DataFrame) -> DataFrame:
    """(query, term, least, top, level, low): the threshold of each list, level + 1, and the most that it adds to a document unseen.

    As many lists as possible, from the lowest head on, stay unread, their heads being less than ``least`` together; the
    others share what is left of it as their common level.
    """
    lists_ = want.join(tops, "term").join(first, "query", "left").select("query", "term", "top", F.coalesce("least", F.lit(0)).alias("least"))
    w, whole = Window.partitionBy("query").orderBy("top", "term"), Window.partitionBy("query")
    rows = lists_.withColumn("under", F.sum("top").over(w)).withColumn("unread", F.col("under") < F.col("least"))
    rows = rows.withColumns({"spent": F.coalesce(F.max(F.when(F.col("unread"), F.col("under"))).over(whole), F.lit(0)), "read": F.count_if(~F.col("unread")).over(whole)})
    rows = rows.withColumn("level", F.when(F.col("unread"), F.col("top")).otherwise(F.expr("greatest(0, least - 1 - spent) div read")))
    return rows.select("query", "term", "least", "top", "level", F.least("level", "top").alias("low"))


def rounds(postings: DataFrame, docs: DataFrame, wanted: DataFrame, weights_: DataFrame, size: tuple[int, int], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query, item_id, term, w) of the lists; (query, uid, sum, low) of what the threshold fetches; (query, uid) of what may be best."""
    want = cut(wanted.join(weights_.where("w > 0"), "term"))
    head = postings.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), "uid"))).where(F.col("at") <= k)
    head = cut(head.select("term", "uid", "score"))
    pairs = want.select("query", "term").join(head, "term").select("query", "uid").distinct()
    first = bound(lookup(docs, pairs, want, size).withColumnRenamed("score", "sum"), k)
    limits = cut(level(want.select("query", "term"), head.groupBy("term").agg(F.max("score").alias("top")), first))
    fetched = postings.join(limits.select("query", "term", "level", "low"), "term").where("score > level")
    seen = cut(fetched.groupBy("query", "uid").agg(F.sum("score").alias("sum"), F.sum("low").alias("low")))
    sums = limits.groupBy("query").agg(F.sum("low").alias("lows"), F.first("least").alias("least")).join(bound(seen, k).withColumnRenamed("least", "more"), "query", "left")
    sums = sums.select("query", "lows", F.greatest("least", "more").alias("least"))
    found = cut(seen.join(sums, "query").where(F.col("sum") + F.col("lows") - F.col("low") >= F.col("least")).select("query", "uid"))
    drop(head, limits)
    return want, seen, found


def search(postings: DataFrame, docs: DataFrame, wanted: DataFrame, weights_: DataFrame, size: tuple[int, int], k: int = K, most: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score) for all queries, by three rounds."""
    want, seen, found = rounds(postings, docs, wanted, weights_, size, k)
    names = want.groupBy("query").agg(F.first("item_id").alias("item_id"))
    out = cut(best(docs, found, want, size, k, most).join(names, "query").select("item_id", "rank", "doc_id", "score"))
    drop(want, seen, found)
    return out


def report(documents: DataFrame, queries: DataFrame, k: int = K, most: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents."""
    prepare(documents.sparkSession)
    wanted = wants(queries)
    terms = wanted.select("term").distinct()
    docs = cut(forward(documents, terms, most))
    size = statistics(docs)
    weight = cut(weights(docs, terms, size[0]))
    postings = cut(lists(docs, weight, size))
    out = search(postings, docs, wanted, weight, size, k, min(most, PAIRS))
    drop(wanted, docs, weight, postings)
    return out


#: The same as DuckDB SQL, from the statement of the scores alone.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
q AS (SELECT r, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM benchmark)),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p GROUP BY term),
x AS (SELECT p.r, p.doc_id, p.term, f.wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * s.docs) // s.words))) AS score FROM p JOIN f USING (term), s),
t AS (SELECT q.r AS q, q.item_id, x.r, x.doc_id, sum(x.score)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY q.r, q.item_id, x.r, x.doc_id HAVING sum(x.score) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM t)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
