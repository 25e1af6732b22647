"""Segmentation, pruned postings, paths of deep trees and many hybrid queries against plain Python."""


import os
import random

import pytest
from pyspark.sql import functions as F

from corpusq.functions.text import tokens
from corpusq.operators import bm25, impact, segmentation, tree
from corpusq.operators import postings as P
from corpusq.plans import lexical_queries as Q

HAN = "天地玄黄宇宙洪荒日月"


def cost_of(words, costs):
    unknown = max(costs.values(), default=0) + 1000
    return sum(costs[w] if w in costs else unknown for w in words)


def splits(run, costs, most):
    """Every way to cut a run into words or single ideographs."""
    if not run:
        yield []
    for k in range(1, min(most, len(run)) + 1):
        if k == 1 or run[:k] in costs:
            for rest in splits(run[k:], costs, most):
                yield [run[:k], *rest]


@pytest.mark.parametrize("seed", range(5))
def test_best_path_is_the_cheapest(seed):
    rnd = random.Random(seed)
    costs = {"".join(rnd.choices(HAN, k=rnd.randrange(1, 5))): rnd.randrange(1, 6) * 1000 for _ in range(40)}
    for _ in range(60):
        run = "".join(rnd.choices(HAN, k=rnd.randrange(0, 11)))
        ways = list(splits(run, costs, 4))
        least = min(cost_of(w, costs) for w in ways)
        assert segmentation.best_path(run, costs, 4) == max((w for w in ways if cost_of(w, costs) == least), key=lambda w: [len(x) for x in w])


def corpus(seed, n=200):
    rnd = random.Random(seed)
    words = ["天地", "玄黄", "宇宙", "洪荒", "日", "月", "天地玄"]
    return [(i, f"d{i % 3}", f"c{i}", "".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))) + rnd.choice(["。", " Python是", " x 中"]) + rnd.choice(words)) for i in range(n)]


def test_lexicon_counts_and_cohesion(spark, monkeypatch):
    import re

    monkeypatch.setattr(segmentation, "PIECE", 7)
    rows = corpus(1)
    df = spark.createDataFrame(rows, "file_id long, dir_id string, chunk_id string, content string")
    counts = {}
    for run in (r for *_, t in rows for r in re.findall("[一-鿿]+", t)):
        for k in range(1, 5):
            for i in range(len(run) - k + 1):
                counts[run[i : i + k]] = counts.get(run[i : i + k], 0) + 1
    got = segmentation.ngrams(df, "content")
    assert {r.word: r.n for r in got.collect()} == counts
    chars = sum(n for w, n in counts.items() if len(w) == 1)
    often = {w: n for w, n in counts.items() if n >= 5}
    kept = {w for w, n in often.items() if len(w) == 1 or min(n * chars / often[w[:k]] / often[w[k:]] for k in range(1, len(w))) >= 2}
    assert {r.word for r in segmentation.lexicon(got, cohesion=2.0).collect()} == kept
    assert {"天地", "玄黄", "宇宙", "洪荒"} <= kept
    assert segmentation.lexicon(got, cohesion=2.0, size=3).count() == 3
    assert segmentation.lexicon(segmentation.ngrams(df.limit(0), "content")).count() == 0


def test_index_and_query_are_cut_alike(spark):
    df = spark.createDataFrame(corpus(2), "file_id long, dir_id string, chunk_id string, content string").withColumn("file_id", F.col("file_id").cast("string"))
    own = segmentation.Segmenter.of(segmentation.lexicon(segmentation.ngrams(df, "content"), cohesion=2.0))
    terms = own.terms("宇宙 Python3 宇宙是")
    assert "宇宙" in terms and "python3" in terms and "是" not in terms
    posts = P.build(df, own)
    assert {(r.chunk_id, r.term): r.tf for r in posts.collect()} == {(c, t): own.terms(text).count(t) for _, _, c, text in corpus(2) for t in set(own.terms(text))}
    found = {r.chunk_id for r in bm25.search(posts, own.terms("宇宙")).collect()}
    assert found == {c for _, _, c, text in corpus(2) if "宇宙" in own.terms(text)} != set()
    same = spark.createDataFrame([("Hello World, a test_1 the é",)], "t string").select(tokens(F.col("t")).alias("a"), tokens(F.col("t"), own).alias("b")).first()
    assert same.a == same.b
    assert own.terms(None) == [] and spark.createDataFrame([(None,)], "t string").select(own.tokens(F.col("t")).alias("x")).first().x == []


def test_words_within_words(spark):
    words = spark.createDataFrame([("天地玄黄", 9, 100), ("天地", 9, 500), ("玄黄", 9, 500), ("地玄黄", 5, 900), ("天", 9, 900)], segmentation.SCHEMA)
    assert segmentation.Segmenter.of(words).terms("天地玄黄") == ["天地", "玄黄", "地玄黄", "天地玄黄"]
    assert segmentation.Segmenter.of(words, search=False).terms("天地玄黄日") == ["天地玄黄", "日"]


def test_segment_query(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no sample tables")
    costs = {r.word: r.cost for r in Q.segment_lexicon(spark, data).collect()}
    texts = {r.chunk_id: r.content for r in Q.ideographs(spark, data).collect()}
    rows = {}
    for r in Q.segment_postings(spark, data).collect():
        for p in r.positions.split(","):
            rows.setdefault(r.chunk_id, {})[int(p)] = r.term
    chosen = sorted(texts, key=lambda c: len(texts[c] or ""))[:25]
    import re

    for c in chosen:
        want = []
        for run, other in re.findall("([一-鿿]+)|([^\\W一-鿿]+)", (texts[c] or "").lower()):
            for w in segmentation.best_path(run, costs, max(map(len, costs))) if run else []:
                want += [w[i : i + k] for k in (2, 3) if len(w) > k for i in range(len(w) - k + 1) if w[i : i + k] in costs] + [w]
            want += [other] if other and not re.fullmatch("[a-z0-9]", other) else []
        assert [rows.get(c, {})[i] for i in sorted(rows.get(c, {}))] == [w for w in want if w not in segmentation.STOP_WORDS]


def made(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(40)]
    return [(str(i // 3), "d", f"c{i:05d}", " ".join(rnd.choices(words, weight, k=rnd.randrange(1, 50)))) for i in range(n)]


@pytest.mark.parametrize("terms,k,size", [(["w0", "w30"], 10, 8), (["w5"], 3, 4), (["w1", "w2", "w39", "w39"], 20, 16), (["w0", "unknown"], 5, 128), (["w3", "w20"], 5000, 8)])
def test_blocks_give_the_same_best(spark, tmp_path, terms, k, size):
    df = spark.createDataFrame(made(900, 3), "file_id string, dir_id string, chunk_id string, content string")
    posts, sizes = P.build(df), P.lengths(df)
    impact.blocks(posts, sizes, size).write.parquet(str(tmp_path / "b"))
    table = spark.read.parquet(str(tmp_path / "b"))
    want = [(r.chunk_id, round(r.score, 9)) for r in bm25.search(posts, terms, top_k=k, lengths=sizes).collect()]
    assert [(r.chunk_id, round(r.score, 9)) for r in impact.search(table, terms, k).collect()] == want
    assert sorted(table.agg(F.sum("n"), F.max("n")).first()) == [min(size, table.agg(F.max("n")).first()[0]), posts.count()]
    assert table.where("n <> size(impacts) or highest <> impacts[0] or array_sort(impacts, (a, b) -> CASE WHEN a > b THEN -1 WHEN a < b THEN 1 ELSE 0 END) <> impacts").isEmpty()


def test_fewer_blocks_are_read_than_there_are(spark, tmp_path):
    df = spark.createDataFrame(made(3000, 4), "file_id string, dir_id string, chunk_id string, content string")
    impact.blocks(P.build(df), P.lengths(df), 16).coalesce(1).write.parquet(str(tmp_path / "b"))
    table = spark.read.parquet(str(tmp_path / "b"))
    got = {r.term: (r.blocks, r["read"]) for r in impact.reads(table, ["w8", "w9"], 10).collect()}
    assert all(r < b for b, r in got.values()) and sum(r for _, r in got.values()) < sum(b for b, _ in got.values()) / 2
    plan = table.where(impact.needed(table, ["w8", "w9"], 10))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(highest" in plan
    assert impact.search(table, [], 5).count() == impact.search(table, ["none"], 5).count() == impact.search(table, ["w0"], 0).count() == 0


NODES = "clue_id string, node_id string, parent_id string, pos int, kind string, name string"


def test_paths_of_a_hundred_levels(spark):
    rows = [("c", "n0", None, 0, "folder", "root")] + [("c", f"n{i}", f"n{i - 1}", 0, "folder", f" f{i}") for i in range(1, 101)]
    rows += [("c", "side", "n50", 3, "leaf", "leaf"), ("c", "x", "y", 0, "folder", "x"), ("c", "y", "x", 0, "folder", "y"), ("c", "z", "x", 0, "leaf", "z"), ("c", "orphan", "gone", 0, "leaf", "o")]
    random.Random(1).shuffle(rows)
    got = {r.node_id: r for r in tree.paths(spark.createDataFrame(rows, NODES)).collect()}
    assert set(got) == {f"n{i}" for i in range(101)} | {"side"}
    assert got["n0"].path == "" and got["n100"].path == "/".join(f"f{i}" for i in range(1, 101))
    assert got["side"].path == got["n50"].path + "/leaf" and got["side"].order == got["n50"].order + "/00000003"
    assert tree.paths(spark.createDataFrame([], NODES)).count() == 0


def test_removing_a_leaf_keeps_all_other_rows(spark, tmp_path):
    from corpusq.engine import Engine

    e = Engine(spark, str(tmp_path / "c"))
    clue = e.clue_create("p", "Deep")
    nodes = e.catalog.read("clue_nodes")
    root = nodes.first()
    rows = [root] + [root.__class__(**root.asDict() | {"node_id": f"n{i}", "parent_id": f"n{i - 1}" if i else root.node_id, "kind": "folder", "name": f"f{i}"}) for i in range(80)]
    rows += [root.__class__(**root.asDict() | {"node_id": n, "parent_id": p, "kind": "leaf", "name": n}) for n, p in (("top", root.node_id), ("end", "n79"), ("lost", "nowhere"))]
    e.catalog.commit(clue_nodes=spark.createDataFrame(rows, nodes.schema))
    e.clue_remove(clue, "top")
    assert {r.node_id for r in e.catalog.read("clue_nodes").collect()} == {r.node_id for r in rows} - {"top"}
    e.clue_remove(clue, "f0/f1")
    assert {r.node_id for r in e.catalog.read("clue_nodes").collect()} == {root.node_id, "n0", "lost"}


def test_many_queries_are_each_as_alone(spark):
    from corpusq.plans import retrieval

    rnd = random.Random(9)
    df = spark.createDataFrame(made(240, 5), "file_id string, dir_id string, chunk_id string, content string")
    vecs = spark.createDataFrame([(f"c{i:05d}", [rnd.gauss(0, 1) for _ in range(6)]) for i in range(240)], "chunk_id string, embedding array<float>")
    asked = [(i, f"w{i} w{i + 1}, w7?", [f"w{i}", f"w{i + 1}"], [rnd.gauss(0, 1) for _ in range(6)]) for i in range(4)]
    queries = spark.createDataFrame(asked, "query_id int, text string, terms array<string>, vector array<double>")
    posts = P.build(df)
    many = retrieval.search_many(df, posts, vecs, queries, 5).collect()
    for i, text, terms, vector in asked:
        one = retrieval.search(df, posts, vecs, vector, text, terms, 5).collect()
        assert [(r.file_id, r.chunk_id, round(r.score, 9), r.chunk_hits) for r in one] == [(r.file_id, r.chunk_id, round(r.score, 9), r.chunk_hits) for r in sorted((m for m in many if m.query_id == i), key=lambda m: m["rank"])]
    assert max(r.chunk_hits for r in many) > 1
    with pytest.raises(ValueError):
        retrieval.search_many(df, posts, vecs, queries, 5, "none")


@pytest.mark.parametrize("name", ["segment_lexicon", "bm25_blocks", "hybrid_many", "eval_methods"])
def test_queries_agree_with_sql(spark, name):
    from tests.test_queries import DATA, test_query_agrees_with_sql

    if not os.path.isdir(DATA):
        pytest.skip("no sample tables")
    test_query_agrees_with_sql(spark, name)


def test_texts_are_cut_and_packed_few_at_a_time(monkeypatch):
    """Tasks turn some texts of a batch into Python objects, not all of them; the words are those of each text alone."""
    import pyarrow as pa

    from corpusq.operators import chunking

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    n = 10 * chunking.ROWS + 3
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([f"text {i}" for i in range(n)])], ["file_id", "content"])
    frame = Frame()
    monkeypatch.setattr(chunking, "F", type("F", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, t: s})())}))
    out = list(chunking.chunk_files(frame, 400, 1 << 30).run(iter([batch])))
    assert max(b.num_rows for b in out) == chunking.ROWS and [x for b in out for x in b.column("content").to_pylist()] == [f"text {i}" for i in range(n)]
    assert segmentation.ROWS <= 1024


def test_segmented_column_over_many_texts(spark):
    words = spark.createDataFrame([("\u4e2d\u6587", 9, 100), ("\u4e2d", 9, 900), ("\u6587", 9, 900)], segmentation.SCHEMA)
    own = segmentation.Segmenter.of(words)
    n = 3 * segmentation.ROWS + 1
    rows = spark.range(n).coalesce(1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("\u4e2d\u6587 x"), F.col("id"))).alias("t"))
    assert {r.id: r.w for r in rows.select("id", own.tokens(F.col("t")).alias("w")).collect()} == {i: ["\u4e2d\u6587", f"x{i}"] if i % 7 else [] for i in range(n)}


def test_blocks_of_chunks_are_those_of_their_postings(spark):
    """Files of several chunks, chunks of several entries, texts without tokens; no single token is shuffled."""
    rnd = random.Random(11)
    rows = [(f"f{i % 9}", "d", f"c{i % 23}-{i % 9}", " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rare%d" % i]) for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [("none", "d", "none", None)]
    chunks = spark.createDataFrame(rows, "file_id string, dir_id string, chunk_id string, content string")
    flat = lambda df: sorted((r.term, c, f, round(x, 9)) for r in df.collect() for c, f, x in zip(r.chunk_ids, r.file_ids, r.impacts))
    made = impact.blocks_of(chunks, size=7)
    assert flat(made) == flat(impact.blocks(P.build(chunks), P.lengths(chunks), 7))
    assert all(r.n <= 7 and r.highest == r.impacts[0] == max(r.impacts) for r in made.collect())
    assert "posexplode" not in made._jdf.queryExecution().toString()


def test_a_query_cuts_texts_into_tokens_once(spark):
    """With lengths, the query's own postings are made once, and the list is the same."""
    from corpusq.plans import retrieval

    chunks = spark.createDataFrame([(str(i), "d", str(i), " ".join(["alpha"] * (i % 3) + ["beta"] * (i % 4) + ["gamma"])) for i in range(40)], "file_id string, dir_id string, chunk_id string, content string")
    vecs = spark.createDataFrame([("1", "d", [1.0, 0.0])], "chunk_id string, dir_id string, embedding array<double>")
    postings, sizes = P.build(chunks), P.lengths(chunks)
    got = retrieval.lists(chunks, postings, vecs, [1.0, 0.0], ["alpha", "beta"], 8, "local", None, sizes)[1]
    rows = lambda df: [(r.chunk_id, round(r.score, 9)) for r in df.orderBy(F.round("score", 9).desc(), "chunk_id").collect()]
    assert rows(got) == rows(bm25.search(postings, ["alpha", "beta"], top_k=8)) and len(rows(got)) == 8
    assert "posexplode" not in got._jdf.queryExecution().toString()


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_blocks_shuffle_postings_of_frequent_terms_once(spark, tmp_path):
    rnd = random.Random(12)
    words = ["w%06d" % rnd.randrange(10**6) for _ in range(3000)]
    rows = [(str(i), "d", str(i), " ".join(rnd.choices(words, k=200))) for i in range(600)]
    chunks = spark.createDataFrame(rows, "file_id string, dir_id string, chunk_id string, content string")
    n = sum(len(set(r[3].split())) for r in rows)
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with vocabularies that are larger than it
    try:
        impact.blocks_of(chunks).write.parquet(str(tmp_path / "b"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < shuffled(spark) - before < 24 * n
    assert spark.read.parquet(str(tmp_path / "b")).agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("often", [0, 1, 3, 1000])
def test_blocks_of_rare_and_frequent_terms(spark, monkeypatch, often):
    """Whether a term's frequency is broadcast or shuffled; several entries of a chunk count as one."""
    monkeypatch.setattr(impact, "OFTEN", often)
    rnd = random.Random(13)
    rows = [(f"f{i % 40}", "d", f"f{i % 40}" if i % 40 < 9 else f"c{i % 80}", " ".join(rnd.choice(["all", "some%d" % (i % 3), "few%d" % (i % 20), "one%d" % i]) for _ in range(rnd.randint(0, 9)))) for i in range(120)] + [("none", "d", "none", None), ("f1", "d", "f1", "  ")]
    chunks = spark.createDataFrame(rows, "file_id string, dir_id string, chunk_id string, content string")
    posts, sizes = P.build(chunks), P.lengths(chunks)
    stats = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    score = bm25.term_score(F.col("tf"), F.col("doc_length"), F.col("mean"), bm25.idf(F.col("n"), F.col("df")))
    want = sorted(map(tuple, posts.join(P.document_frequency(posts), "term").crossJoin(stats).select("term", "chunk_id", "file_id", F.round(score, 9)).collect()))
    for made in (impact.blocks(posts, sizes, 4), impact.blocks_of(chunks, size=4)):
        assert sorted((r.term, c, f, round(x, 9)) for r in made.collect() for c, f, x in zip(r.chunk_ids, r.file_ids, r.impacts)) == want


@pytest.mark.parametrize("block,pairs", [(1024, 1 << 20), (2, 3)])
def test_many_keyword_queries_are_each_as_alone(spark, monkeypatch, block, pairs):
    """Repeated, unknown, null and no terms; equal scores; chunk ids that two files share."""
    monkeypatch.setattr(bm25, "PAIRS", pairs)
    rows = [(f, "d", c, t) for f, _, c, t in made(60, 6)] + [(f, "d", "same", "w0 w1 other") for f in ("x", "y")] + [("z", "d", f"e{i}", "w3 equal") for i in range(9)]
    posts = P.build(spark.createDataFrame(rows, "file_id string, dir_id string, chunk_id string, content string"))
    asked = {1: ["w0", "w0", "w1"], 2: ["equal"], 3: ["none"], 4: ["w3", "w39", "other"], 5: [None, "w5"], 2**40: ["w0", "w1", "w2", "none"]}
    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = bm25.search_many(posts, queries, 6, block).collect()
    for q, ts in asked.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        every = sorted(((-round(r.score, 9), r.chunk_id, r.file_id) for r in bm25.search(posts, [t for t in ts if t]).collect()))
        assert [(-round(r.score, 9), r.chunk_id) for r in own] == [x[:2] for x in every[:6]]
        assert {(-round(r.score, 9), r.chunk_id, r.file_id) for r in own} <= set(every) and [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert bm25.search_many(posts, queries.limit(0), 6).isEmpty() and bm25.search_many(posts.limit(0), queries, 6).isEmpty()


def test_many_keyword_queries_shuffle_their_best_only(spark):
    """Not every chunk that a query matches: that grows with queries times chunks."""
    posts = P.build(spark.createDataFrame(made(600, 7), "file_id string, dir_id string, chunk_id string, content string"))
    queries = spark.range(400).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("w0"), F.lit("w1"), F.concat(F.lit("w"), F.col("id") % 40))).alias("term"))
    before = shuffled(spark)
    assert bm25.search_many(posts, queries, 5).count() == 2000
    assert shuffled(spark) - before < 1_000_000


def test_lists_of_compared_methods_are_made_once(spark, monkeypatch):
    from corpusq.operators import vectors
    from corpusq.plans import retrieval

    made_by, of = [], {}
    for module, name in ((vectors, "knn_many"), (bm25, "search_many")):
        of[name] = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, n=name, **b: made_by.append(n) or of[n](*a, **b))
    df = spark.createDataFrame(made(60, 8), "file_id string, dir_id string, chunk_id string, content string")
    vecs = df.select("chunk_id", F.array(F.lit(1.0), F.length("content").cast("double")).alias("embedding"))
    queries = spark.createDataFrame([(i, "w1 w2", ["w1", "w2"], [1.0, float(i)]) for i in range(3)], "query_id int, text string, terms array<string>, vector array<double>")
    expected = spark.createDataFrame([(i, str(i)) for i in range(3)], "query_id int, id string")
    assert retrieval.compare(df, P.build(df), vecs, queries, expected, 5).count() == 3
    assert sorted(made_by) == ["knn_many", "search_many"]
