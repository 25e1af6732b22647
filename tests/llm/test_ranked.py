"""op12: TPUT against scoring every document for every query."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.llm import ranked as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(R.TERM, (text or "").translate(LOWER))


def brute(documents, queries, k=R.K):
    docs = [(i, terms(t)) for i, t in documents]
    count, length = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        scores = []
        for i, w in docs:
            m = 10 + 90 * len(w) * count // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(spark, documents, queries, **more):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(3).withColumns({"uid": F.lit(1), "n": F.lit("x"), "terms": F.lit(2), "score": F.lit(3)})
    q = spark.createDataFrame(queries, "item_id long, text string").withColumns({"query": F.lit(1), "term": F.lit("x")})
    return sorted((tuple(r) for r in R.report(d, q, **more).collect()), key=str)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ΣΑΣ", "中文", "x9"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weight, k=rnd.randrange(0, 60))) + rnd.choice(["", ".", "!W1", "w2-W3"])) for i in range(n)]
    queries = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for i in range(25)]
    return docs, queries


@pytest.mark.parametrize("seed,k,most", [(1, 10, R.TERMS), (2, 3, R.TERMS), (3, 10, 2)])
def test_agrees_with_brute_force(spark, seed, k, most):
    docs, queries = corpus(300, seed)
    assert got(spark, docs, queries, k=k, most=most) == brute(docs, queries, k)


def test_ties_copies_and_nulls(spark):
    docs, queries = corpus(80, 4)
    docs += [(None, "w1 w2"), (None, None), (500, None), (501, ""), (502, "...")] + [(600 - i, "w40 w41 w40") for i in range(40)] + [(7, "w40 w41 w40")] * 3
    queries += [(None, "w40 W41"), (None, "w40 W41"), (900, None), (901, ""), (902, "unseen words"), (903, "w40 unseen")]
    assert got(spark, docs, queries) == brute(docs, queries)


def test_words_of_all_documents_and_empty_tables(spark):
    docs = [(i, "all the same") for i in range(30)]
    assert got(spark, docs, [(1, "all"), (2, "same the")]) == brute(docs, [(1, "all"), (2, "same the")])
    assert got(spark, [], [(1, "a")]) == got(spark, docs, []) == got(spark, [(1, None)], [(1, "a")]) == []


def test_long_texts(spark):
    docs = [(1, "alpha beta " * 500_000), (2, "alpha" + "," * 2_000_000 + "gamma"), (3, "z" * 3_000_000), (4, "beta")]
    queries = [(1, "alpha"), (2, "gamma beta"), (3, "z" * 3_000_000)]
    assert got(spark, docs, queries) == brute(docs, queries)


def test_rounds_prune(spark):
    docs, _ = corpus(2000, 5)
    queries = [(1, "w50 w51 w0 w1"), (2, "中文 w0")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    wanted = R.wants(q)
    f = R.cut(R.forward(d, wanted.select("term").distinct()))
    size = R.statistics(f)
    w = R.cut(R.weights(f, wanted.select("term").distinct(), size[0]))
    postings = R.cut(R.lists(f, w, size))
    rows = R.rounds(postings, f, wanted, w, size, 10)
    fetched, found, everything = rows[1].count(), rows[2].count(), postings.join(wanted, "term").select("query", "uid").distinct().count()
    assert 20 <= found < fetched < everything / 2


def test_query_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no sample tables")
    tables = ", ".join(f"{n} AS (FROM '{data}/{n}.parquet')" for n in ("documents", "benchmark"))
    want = duckdb.sql(f"WITH {tables}, " + R.SQL.strip().removeprefix("WITH ")).fetchall()
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    assert sorted(want) == sorted(tuple(r) for r in R.report(read("documents"), read("benchmark")).collect())
