import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from corpusq.llm import langid as G
from corpusq.llm import ppm as P
from corpusq.llm import text as T


def brute(train: list[str], text: str, contexts=None) -> float:
    """Code length in bits by following the escapes symbol by symbol."""
    seen: dict[bytes, Counter] = {}
    for t in train:
        b = b"\0\0\0" + t.encode() + b"\0"
        for i in range(3, len(b)):
            for k in range(4):
                seen.setdefault(b[i - k : i], Counter())[b[i]] += 1
    out = 0.0
    b = b"\0\0\0" + text.encode() + b"\0"
    for i in range(3, len(b)):
        excluded, p = set(), 1.0
        for k in (3, 2, 1, 0):
            c = {s: n for s, n in seen.get(b[i - k : i], {}).items() if s not in excluded}
            if not c:
                continue
            kinds = 0 if len(excluded) + len(c) == 256 else len(c)
            n = sum(c.values()) + kinds
            if b[i] in c:
                p *= c[b[i]] / n
                break
            p *= kinds / n
            excluded |= set(c)
        else:
            p /= 256 - len(excluded)
        out -= math.log2(p)
    return out


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcab é\n") for _ in range(rnd.randrange(0, 60))) for _ in range(n)]


def test_code_lengths_match_brute_force(spark):
    train = {"x": texts(30), "y": [t.upper() for t in texts(20, 2)] + [""]}
    rows = spark.createDataFrame([(k, t) for k, v in train.items() for t in v], "label string, text string")
    counts = rows.mapInArrow(P.by_label, "label string, code bigint, n bigint").groupBy("label", "code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    model = P.trees(counts)
    probe = texts(15, 5) + ["", "Zzé中", "ABAB C"]
    buf, off = T.text_buffer(pa.array(probe))
    got = P.lengths(list(model.values()), buf, off)
    assert list(model) == ["x", "y"]
    for i, label in enumerate(model):
        for t, x in zip(probe, got[i]):
            assert x == pytest.approx(brute(train[label], t), rel=1e-9)


def test_small_trees_are_proper_codes(spark):
    import numpy as np

    rows = spark.createDataFrame([("x", t) for t in texts(30)], "label string, text string")
    counts = rows.mapInArrow(P.by_label, "label string, code bigint, n bigint").groupBy("label", "code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    model = P.build(counts, order3=5, order2=4)
    assert len(model.three) <= 5 and len(model.two) <= 4
    assert np.allclose(np.exp2(-model.cost.reshape(-1, 256).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_a_tree_where_every_byte_is_seen():
    import numpy as np

    rng = np.random.default_rng(1)
    data = [rng.integers(0, 256, 4000).astype(np.uint8).tobytes() + bytes(range(256)) * 2 for _ in range(3)]
    code, _ = P.codes(np.frombuffer(data[0], np.uint8), np.array([0, len(data[0])]))
    keys, n = np.unique(code, return_counts=True)
    tree = P.Tree.of(keys.astype(np.int64), n)
    for context in [0, 5, *(int(k) >> 8 for k in keys[:40])]:
        row = tree.cost(np.arange(256, dtype=np.int64) | context << 8)
        assert np.exp2(-row).sum() == pytest.approx(1, abs=1e-9)


def test_ties_do_not_empty_the_head(spark):
    t = spark.range(5000).selectExpr("id as context", "7L as total")
    kept = P.frequent(t, 200).count()
    assert kept == 200
    assert P.frequent(t, 5000).count() == 5000 and P.frequent(t, 0).count() == 0
    more = t.unionByName(spark.range(6000, 6050).selectExpr("id as context", "900L as total"))
    got = {r.context for r in P.frequent(more, 200).collect()}
    assert set(range(6000, 6050)) <= got and len(got) == 200


def test_many_languages(spark):
    """200 languages, each with an alphabet of its own order: a tree holds all of its contexts."""
    import numpy as np

    rnd = random.Random(8)
    docs = []
    for k in range(200):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(30)]
        docs += [(10 * len(docs) + j, " ".join(rnd.choice(words) for _ in range(25)), f"l{k:03d}") for j in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as row", "'x' as label", "0.5 as score")
    model = G.fit(df)
    assert len(model) == 200
    truth = {d: k for d, _, k in docs}
    held = [r.lang_pred == truth[r.doc_id] for r in G.report(df).collect() if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_equal_trees_tie_to_the_first(spark):
    df = spark.createDataFrame([(1, "some words", "b"), (1, "some words", "a"), (2, "some words", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in G.report(df).collect()} == {("a", 0.5)}


def test_languages(spark):
    rnd = random.Random(3)
    word = {"aa": "lorem ipsum dolor", "bb": "quick brown foxes", "cc": "été où ça"}
    docs = [(i, " ".join(rnd.choice(word[k].split()) for _ in range(rnd.randrange(3, 30))), k) for i in range(150) for k in [rnd.choice(sorted(word))]]
    docs += [(900, None, "aa"), (901, "", None), (902, "123 $", "aa"), (903, "١٢٣", "bb"), (904, "où ça été", None), (None, "lorem", "aa"), (1, docs[1][1], docs[1][2]), (905, "ipsum " * 40000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = G.report(df).collect()
    assert len(got) == len(docs)
    truth = {i: k for i, _, k in docs[:150]}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904, 905)] == ["und", "und", "und", "und", "cc", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and by[900].score == 0
    empty = df.limit(0)
    assert G.report(empty).count() == 0
    assert {r.lang_pred for r in G.predict(df, G.fit(empty)).collect()} == {"und"}


def test_functions_travel_light():
    """Power tables that the driver has made for itself stay there."""
    import numpy as np
    from pyspark import cloudpickle

    from corpusq.llm import substring

    T.hash_spans(np.frombuffer(b"a b", np.uint8), np.array([0, 2]), np.array([1, 3]))
    sent = cloudpickle.dumps(substring._contents)
    assert len(sent) < 1 << 17
    assert len(T._POW) == 2 and callable(cloudpickle.loads(sent))
