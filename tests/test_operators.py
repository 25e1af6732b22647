import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq import config
from corpusq.functions import text as X
from corpusq.operators import bm25, changes, chunking, evaluation, fusion, lines, pages, sheets, tree, vectors
from corpusq.operators import postings as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_and_text(spark):
    assert one(spark, X.tokens(F.lit("The cat, a 9 x2 _y 的 Été"))) == ["cat", "x2", "_y", "été"]
    assert one(spark, X.tokens(F.lit("The  Cat."), "cloud")) == ["the", "cat."]
    assert one(spark, X.tokens(F.lit("我 有 cat"), "library")) == ["cat"]
    assert one(spark, X.tokens(F.lit("全文检索 v2"), "cjk")) == ["全文", "文检", "检索", "v2"]
    assert one(spark, X.sentences(F.lit("Pi is 3.14. Yes! 好。 end"))) == ["Pi is 3.14.", "Yes!", "好。", "end"]
    assert one(spark, X.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(1))) == "b"
    assert one(spark, X.line_slice(F.lit("a\nb\nc"), F.lit(0), F.lit(9))) == "a\nb\nc"
    assert one(spark, X.locator_range(F.lit("lines:3-9"))) == (3, 9)
    assert one(spark, X.locator_range(F.lit("page:3"))) is None
    assert one(spark, X.snippet(F.lit("x" * 40 + "needle" + "y" * 40), F.lit("needle"))) == "..." + "x" * 24 + "needle" + "y" * 24 + "..."
    assert one(spark, X.snippet(F.lit("short text"), F.lit("none"))) == "short text"
    assert one(spark, X.snippet(F.lit("\n" + "x" * 40 + "dogs\n"), F.lit(" cats, dogs "))) == "..." + "x" * 24 + "dogs"
    assert one(spark, X.snippet(F.lit("  "), F.lit("a"))) == one(spark, X.snippet(F.lit("text"), F.lit(" "))) == ""
    assert one(spark, X.strip_page_markers(F.lit("\n<!-- page: 1 -->\na\n\n\n\nb\n"))) == "a\n\nb"
    assert one(spark, X.relative_path(F.lit("a/b/c"), F.lit("a"))) == "b/c"
    assert one(spark, X.chunk_id(F.lit("f"), F.lit(12345))) == "f:12345"
    for url, bad in (("http://10.1.2.3/x", True), ("ftp://a.b", True), ("https://example.com/a", False), ("http://172.20.1.1", True), ("nonsense", True)):
        assert one(spark, X.private_host(F.lit(url))) is bad
    assert X.query_terms("What is (really) the plan？ a b cats/dogs cats") == ["What", "is", "the", "plan", "cats", "dogs"]


@pytest.mark.parametrize(("pattern", "path", "ok"), [("**/*.md", "a/b.md", True), ("**/*.md", "b.md", True), ("*.md", "a/b.md", False), ("a?c/**", "abc/x/y", True), ("", "x/y", True), ("a.b", "axb", False)])
def test_glob(pattern, path, ok):
    import re

    assert bool(re.match(X.glob_regex(pattern), path)) is ok


def test_bm25_numbers(spark):
    chunks = spark.createDataFrame([("f1", "d1", "f1:0", "alpha beta alpha"), ("f1", "d1", "f1:1", "beta gamma"), ("f2", "d2", "f2:0", "alpha")], "file_id string, dir_id string, chunk_id string, content string")
    posts = P.build(chunks)
    rows = {(r.term, r.chunk_id): r for r in posts.collect()}
    assert rows["alpha", "f1:0"].positions == [0, 2] and rows["alpha", "f1:0"].doc_length == 5
    got = {r.chunk_id: r.score for r in bm25.search(posts, ["beta"]).collect()}
    idf = math.log((2 - 1 + 0.5) / 1.5 + 1)
    assert got["f1:1"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 5 / 3)))
    assert bm25.search(posts, ["beta", "beta"]).collect()[0].score == pytest.approx(2 * bm25.search(posts, ["beta"]).where("chunk_id = 'f1:0'").first().score)
    assert bm25.search(posts, ["alpha"], dirs=[]).isEmpty() and bm25.search(posts, ["alpha"], top_k=0).isEmpty()
    assert {r.chunk_id for r in bm25.search(posts, ["alpha"], dirs=["d2"]).collect()} == {"f2:0"}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 2.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6)) for r in vectors.knn(rows, [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (2, 0.5), (3, 0.5)]
    assert vectors.knn(rows, [1.0, 0.0], 0).isEmpty()
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vector array<double>")
    many = vectors.knn_many(rows.where("vec_id < 3"), q, 1, block=1).collect()
    assert {(r.query_id, r.vec_id) for r in many} == {("a", 1), ("b", 2)}


def test_fusion_numbers(spark):
    lists = spark.createDataFrame([("red", 0, "words", 1), ("blue", 0, "words", 2), ("green", 0, "words", 3), ("green", 1, "vectors", 1), ("red", 1, "vectors", 4)], "id string, list_idx int, list_name string, rank int")
    got = {r.id: r for r in fusion.rrf(lists).collect()}
    assert got["red"].score == pytest.approx(1 / 61 + 1 / 64) and sorted(got["red"].sources) == ["vectors", "words"]
    assert got["green"].score == pytest.approx(1 / 63 + 1 / 61) and got["blue"].sources == ["words"]
    rows = [("n1", "/notes/n.md", 0.4, 2, ["words"]), ("n2", "/notes/n.md", 0.7, 1, ["vectors"]), ("n3", "/notes/n.md", 0.2, 5, ["words"]), ("p1", "/p.md", 0.75, 3, ["words"]), ("alone", " ", 0.05, 4, ["words"])]
    items = spark.createDataFrame(rows, "chunk_id string, file_key string, score double, ord int, sources array<string>")
    g = {r.file_key: r for r in fusion.group_by_file(items, 0.25).collect()}
    assert g["/notes/n.md"].score == pytest.approx(0.7 + 0.25 * (0.4 + 0.2)) and g["/notes/n.md"].chunk_ids == ["n2", "n1", "n3"] and g["/notes/n.md"].sources == ["vectors", "words"]
    assert "__chunk__:alone" in g and fusion.group_by_file(items, 0).where("file_key = '/notes/n.md'").first().score == pytest.approx(0.7)
    assert fusion.group_by_file(items, top_k=0).isEmpty()


def test_entries_of_one_chunk_are_appended(spark):
    rows = [("f", "d", "c", "alpha beta", "lines:2-3"), ("f", "d", "c", "beta gamma alpha", "lines:10-12"), ("f", "d", "c", "alpha alpha", "lines:11-14")]
    chunks = spark.createDataFrame(rows, "file_id string, dir_id string, chunk_id string, content string, locator string")
    got = {r.term: r for r in P.build(chunks).collect()}
    assert (got["alpha"].locator, got["alpha"].positions, got["alpha"].tf) == ("lines:2-3", [0, 2, 0, 1], 4)
    assert (got["beta"].locator, got["beta"].positions, got["gamma"].locator) == ("lines:2-3", [1, 0], "lines:10-12")
    turned = chunks.selectExpr("*", "-cast(regexp_extract(locator, '([0-9]+)', 1) as int) as entry")
    assert {r.term: r for r in P.build(turned).collect()}["alpha"].locator == "lines:11-14"
    assert got["alpha"].doc_length == 7


def test_many_queries_clean_vectors_as_one_does(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [0.6, 0.8])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [0.8, 0.6]), (8, [0.0, 0.0])], "query_id long, vector array<double>")
    for metric in ("cosine", "l2", "dot"):
        many = [(r.vec_id, round(r.score, 9)) for r in vectors.knn_many(rows, asked, 9, metric).where("query_id = 7").orderBy("rank").collect()]
        assert many == [(r.vec_id, round(r.score, 9)) for r in vectors.knn(rows, [0.8, 0.6], 9, metric).collect()]
    assert vectors.knn_many(rows, asked, 9).where("query_id = 8").isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?。\n#`=-", max_size=400), st.integers(2, 30))
def test_chunks_cover_the_text_and_keep_their_size(markdown, most):
    got = chunking.chunk(markdown, most // 2, most, 0.1, len)
    seen = "".join(c.content for c in got)
    assert all(ch in seen for ch in set(markdown) if not ch.isspace())
    n = markdown.count("\n") + 1
    assert all(1 <= c.first <= c.last <= n for c in got)
    assert all(c.tokens <= most for c in got)


def test_sections():
    md = "intro\n\n# A\ntext\n```\n# no\n```\nB\n===\nmore"
    assert [(a, b) for _, a, b in chunking.sections(md)] == [(1, 2), (3, 7), (8, 10)]
    long = " ".join(f"Sentence {i}." for i in range(40))
    parts = list(chunking.pack(long, 60, 0.1, len))
    assert all(n <= 60 for _, n in parts) and parts[1][0].startswith(parts[0][0].rsplit(". ", 1)[-1].rstrip("."))


def test_lines(spark):
    f = spark.createDataFrame([("a", "x\nNeedle\ny\nz"), ("b", "")], "path string, content string")
    r = lines.grep(f, "needle", context=1).collect()
    assert [(x.path, x.line_no, x.before, x.after) for x in r] == [("a", 2, ["x"], ["y"])]
    assert lines.grep(f, "").count() == 5
    text = "Page 1\nbody\nmore\nPage 9"
    assert one(spark, lines.strip_boilerplate(F.lit(text), F.array(F.lit("page #")))) == "body\nmore"


def test_trees(spark):
    rows = [("c", "r", None, 0, "folder", "root", None), ("c", "f", "r", 0, "folder", "F", None), ("c", "e", "r", 1, "folder", "Empty", None), ("c", "l", "f", 0, "leaf", "L", "x"), ("c", "m", "r", 2, "leaf", "M", "y")]
    nodes = spark.createDataFrame(rows, "clue_id string, node_id string, parent_id string, pos int, kind string, name string, file_id string")
    p = tree.paths(nodes)
    assert {r.path for r in p.collect()} == {"", "F", "Empty", "F/L", "M"}
    assert tree.find(p, " F / L ").first().node_id == "l"
    assert {r.node_id for r in tree.remove_files(p, ["x"]).collect()} == {"r", "e", "m"}
    assert {r.node_id for r in tree.remove(p, "F").collect()} == {"r", "e", "m"}
    assert tree.render([r.asDict() for r in nodes.collect()]) == "root\n├── F/\n│   └── L\n├── Empty/\n└── M"
    new = nodes.where("node_id = 'm'").withColumns({"node_id": F.lit("n"), "name": F.lit("New")})
    added = tree.add_child(nodes, "r", new, 1)
    assert {r.node_id: r.pos for r in added.where("parent_id = 'r'").collect()} == {"f": 0, "n": 1, "e": 2, "m": 3}
    with pytest.raises(ValueError):
        tree.add_child(nodes, "r", nodes.where("node_id = 'm'"))
    assert tree.update(nodes, "m", name="Z").where("name = 'Z'").count() == 1
    moved = {r.node_id: r.path for r in tree.update(p, "f", name=" G ").collect()}
    assert moved == {"r": "", "f": "G", "e": "Empty", "l": "G/L", "m": "M"}
    with pytest.raises(ValueError):
        tree.update(p, "f", name="Empty")
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(12)], "id string, parent_id string")
    deep = tree.expand(chain, chain.where("id = '0'"))
    assert deep.count() == 12 and "Join" not in deep._jdf.queryExecution().optimizedPlan().toString()
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    assert tree.expand(loop, loop.where("id = 'a'")).count() == 2


def test_changes(spark):
    e = spark.createDataFrame([("f", 1, "pending"), ("f", 2, "indexing"), ("f", 3, "indexed"), ("g", 1, "pending"), ("g", 2, "indexed")], "k string, ts int, status string")
    assert {(r.k, r.status) for r in changes.latest(e, "k", "ts", "status").collect()} == {("f", "indexed"), ("g", "indexed")}
    assert [r.k for r in changes.bad_moves(e, "k", "ts").collect()] == ["g"]
    files = spark.createDataFrame([("f", "indexing", None)], "k string, status string, error_message string")
    bad = changes.merge_failed(files, spark.createDataFrame([("f", "e" * 900)], "k string, message string"), "k").first()
    assert bad.status == "failed" and len(bad.error_message) == 500


def test_evaluation(spark):
    h = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank int")
    x = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "query_id string, id string")
    got = {r.query_id: r for r in evaluation.per_query(h, x, 2).collect()}
    assert (got["q"].precision_at_k, got["q"].recall_at_k, got["q"].mrr, got["p"].mrr) == (0.5, 0.5, 0.5, 0.0)
    v = spark.range(1, 21).withColumn("v", F.col("id").cast("double"))
    assert evaluation.latency(v, "v").first().p95 == 19


def test_sheets():
    assert [sheets.letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and sheets.number("AAA") == 703
    assert sheets.parse_a1("Sheet1!$B$2:C10") == (2, 2, 10, 3) and sheets.a1(2, 2, 10, 3) == "B2:C10"
    assert sheets.split_regions({(1, 1), (2, 1), (6, 1), (6, 9)}) == [(1, 1, 2, 1), (6, 1, 6, 1), (6, 9, 6, 9)]
    assert sheets.split_regions({(1, 1), (6, 1)}, joined=lambda axis, edge: True) == [(1, 1, 6, 1)]
    assert sheets.components({(1, 1), (1, 2), (2, 1), (2, 2), (9, 9), (9, 10)}) == [(1, 1, 2, 2)]


@pytest.mark.parametrize("rule,least", [("any", 0.8), ("mean", 0.5), ("mean", 0.0)])
def test_compression(spark, rule, least):
    import random

    rng = random.Random(5)
    boxes = {"a": (1, 1, 30, 20), "b": (3, 2, 60, 9), "c": (1, 1, 4, 4), "d": (1, 1, 2, 300), "e": (1, 1, 500, 1)}
    kinds = {s: {(r, c): rng.choice(["Text", "Number", "Empty"]) if (r % 3 == 0 if s in "bd" else c % 4 == 0) else "Text" for r in range(t, b + 1) for c in range(left, right + 1)} for s, (t, left, b, right) in boxes.items()}
    cells = spark.createDataFrame([(s, r, c, k) for s, g in kinds.items() for (r, c), k in g.items()], "sheet string, row int, col int, dtype string")
    found = spark.createDataFrame([(s, *b) for s, b in boxes.items()], "sheet string, top int, left int, bottom int, right int")
    got = {r.sheet: (r.mode, r.kept, round(r.ratio, 9)) for r in sheets.compression_plans(cells, found, rule, least).collect()}
    for s, (t, left, b, right) in boxes.items():
        g, h, w = kinds[s], b - t + 1, right - left + 1
        share = lambda x: (max if rule == "any" else lambda v: sum(v) / len(v))(x)
        rows = [r for r in range(t, b + 1) if (share([float(g[r, c] != g[r - 1, c]) for c in range(left, right + 1)]) if r > t else 0) >= least]
        cols = [c for c in range(left, right + 1) if (share([float(g[r, c] != g[r, c - 1]) for r in range(t, b + 1)]) if c > left else 0) >= least]
        x, y = 1 - len(rows) / h, 1 - len(cols) / w
        want = ("none", None, 0.0) if h * w < 400 else ("row", rows, round(x, 9)) if x > y and x > 0.1 else ("column", cols, round(y, 9)) if y > x and y > 0.1 else ("none", None, 0.0)
        assert got[s] == want


def test_pages_are_found_from_the_page_before_on():
    text = "\n".join(["same", "one", "same", "two", "end", "rest"] + ["x"] * 6)
    assert pages.page_ranges(text, [(1, ["same", "one"]), (2, ["same", "end"]), (3, []), (4, ["missing"]), (5, ["x"])]) == [(1, 1, 2), (2, 3, 5), (3, 6, 8), (4, 9, 10), (5, 11, 11)]
    assert pages.page_ranges("\n" * 49, []) == [(1, 1, 17), (2, 18, 34), (3, 35, 50)]
    assert pages.page_ranges("a", [(1, ["a"]), (2, ["a"])]) == [(1, 1, 1)]


def test_config():
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": None, "e": 4}, "d": [1]}) == {"a": {"c": 2, "e": 4}, "d": [1]}
    assert config.substitute({"k": ["${X}-y"]}, {"X": "1"}) == {"k": ["1-y"]}
    assert config.resolve({"search": {"default_top_k": 5}})["search"]["default_top_k"] == 5
    for bad in ({"embedding": {"batch_size": 65}}, {"search": {"fusion": {"method": "x"}}}, {"summary": {"mode": "x"}}):
        with pytest.raises(ValueError):
            config.resolve(bad)


def test_boxes_of_many_sheets_at_once(spark):
    """Regions and tables of random sheets are those of the plain definitions, without Python for each sheet."""
    import random

    rnd = random.Random(5)
    cells = []
    for s in range(60):
        for _ in range(rnd.choice([1, 3, 12, 40])):
            r, c = rnd.randint(1, 14), rnd.randint(1, 9)
            cells += [(f"s{s}", r, c, rnd.choice(["x", "x", ""]), "", rnd.random() < 0.5, rnd.choice(["", None, "red", "blue"]))] * rnd.choice([1, 1, 2])
    cells += [("one", 1, 1, "x", "", False, "")]
    df = spark.createDataFrame(cells, "sheet string, row int, col int, value string, formula string, bordered boolean, bg string")
    names = {c[0] for c in cells}
    box = lambda df: sorted((r.sheet, r.range, r.top, r.left, r.bottom, r.right) for r in df.collect())
    brute = lambda found: sorted((s, sheets.a1(*b), *b) for s in names for b in found(s))
    assert box(sheets.regions(df)) == brute(lambda s: sheets.split_regions({(c[1], c[2]) for c in cells if c[0] == s and (c[3] or c[5])}))
    kinds = {}
    for s, r, c, _, _, line, bg in cells:
        if line or bg:
            kinds.setdefault((s, line or bg), set()).add((r, c))
    assert box(sheets.tables(df)) == brute(lambda s: {b for (t, _), points in kinds.items() if t == s for b in sheets.components(points)})
    for found in (sheets.regions(df), sheets.tables(df)):
        assert "InPandas" not in found._jdf.queryExecution().toString() and found.where("sheet = 'none'").count() == 0
    assert sheets.tables(df.where("sheet = 'one'").withColumn("bg", F.lit("red"))).count() == 0


def test_sheets_longer_than_a_batch(spark):
    """A sheet's cells stay together where they come in several batches."""
    import pyarrow as pa

    rows = [("a", i) for i in range(3)] + [("b", i) for i in range(11)] + [("c", 0)] + [("d", i) for i in range(5)]
    batches = [pa.RecordBatch.from_pylist([{"sheet": s, "row": r} for s, r in rows[i : i + 4]]) for i in range(0, len(rows), 4)]
    got = [[(x["sheet"], x["row"]) for x in t.to_pylist()] for t in sheets._whole_sheets(iter(batches))]
    assert [x for t in got for x in t] == rows and not any({s for s, _ in a} & {s for s, _ in b} for i, a in enumerate(got) for b in got[i + 1 :])


def within(spark, seconds, rows):
    """The collected rows, by a job that is cancelled after some time."""
    import threading

    spark.sparkContext.setJobGroup("within", "bounded", True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, ["within"])
    timer.start()
    try:
        return rows.collect()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equal_line_ranges_meet_once(spark):
    """60 000 rows on either side, all in one file: the pairs would be 3.6 billion, the distinct ranges are few."""
    n = 60000
    i = F.col("id")
    r = spark.range(n).select(F.lit("f").alias("file_id"), i, (i % 3 + 1).alias("first"), (i % 3 + 3).alias("last"))
    m = spark.range(n).select(F.lit("f").alias("file_id"), i.alias("pos"), F.lit(2).alias("first"), (i % 2 + 4).alias("last"), F.concat(F.lit("p"), i).alias("locator"))
    got = within(spark, 90, lines.best_overlap(r, m).groupBy("locator", "overlap").agg(F.count("*").alias("n")))
    assert {(x.locator, x.overlap): x.n for x in got} == {("p0", 2): n // 3, ("p0", 3): n // 3, ("p1", 3): n // 3}
    entries = r.select("file_id", i.alias("entry"), (i % 3 + 3).alias("line"))
    chunks = m.select("file_id", F.col("pos").alias("idx"), F.col("locator").alias("chunk_id"), "first", "last")
    got = within(spark, 90, lines.entry_chunks(entries.unionByName(entries.limit(1).withColumn("line", F.lit(99).cast("bigint"))), chunks).groupBy("line", "chunk_id").agg(F.count("*").alias("n")))
    assert {(x.line, x.chunk_id): x.n for x in got} == {(3, f"p{n - 1}"): n // 3, (4, f"p{n - 1}"): n // 3, (5, f"p{n - 1}"): n // 3, (99, None): 1}


def test_metrics_of_labels_are_those_of_all_pairs(spark):
    from corpusq.operators import evaluation

    items = spark.createDataFrame([(i, i % 4 if i % 7 else None) for i in range(60)], "id long, label int")
    queries = items.where("id % 5 = 0").select(F.col("id").alias("query_id"), "label")
    hits = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank")).select("query_id", ((F.col("query_id") * 7 + F.col("rank") * F.col("rank")) % 60).alias("id"), "rank").where("query_id <> 20")
    expected = queries.join(items, "label").select("query_id", "id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluation.per_query_of_label(hits, queries, items, 5)) == rows(evaluation.per_query(hits, expected, 5))
    assert rows(evaluation.missed_of_label(hits, queries, items)) == rows(evaluation.missed(hits, expected).groupBy("query_id").agg(F.count("*").alias("missed")))


def test_nearest_rows_are_kept_in_bounded_memory(spark):
    """A task holds some blocks of scores, whatever the batches; ties by key, also over blocks and batches."""
    import tracemalloc

    import numpy as np

    from corpusq.operators import vectors

    rng = np.random.default_rng(3)
    best, seen = vectors._Best(1024, 10), []
    for b in range(4):
        s = rng.integers(0, 500, (1024, 1024)) / 500
        keys = np.arange(b * 1024, (b + 1) * 1024)[::-1]
        seen.append((s[::100], keys))
        tracemalloc.start()
        best.add(s, keys)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
        tracemalloc.stop()
    s, keys = np.concatenate([x for x, _ in seen], axis=1), np.concatenate([x for _, x in seen])
    query, score, key = best.held
    for i, row in enumerate(s):
        order = np.lexsort((keys, -row))[:10]
        own = query == i * 100
        assert key[own].tolist() == keys[order].tolist() and score[own].tolist() == row[order].tolist()
    rows = spark.createDataFrame([(f"v{i:04d}", [float(i % 5), 1.0 if i % 11 else None, 0.0]) for i in range(300)] + [("none", None), ("zero", [0.0, 0.0, 0.0])], "vec_id string, embedding array<double>").repartition(3)
    asked = rows.where("vec_id in ('v0001', 'v0007', 'zero')").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in vectors.knn_many(rows, asked, 4, block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {"v0001": ["v0001", "v0006", "v0016", "v0021"], "v0007": ["v0002", "v0007", "v0012", "v0017"]}
