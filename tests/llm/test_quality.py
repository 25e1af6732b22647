import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusq.llm import quality as Q
from corpusq.llm import text as T


def corpus(n=240, seed=3):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = i % 2
        w = [rnd.choice("alpha beta gamma delta éps zeta eta".split()) for _ in range(rnd.randrange(5, 60))]
        docs.append((i, " ".join(w) if y else " ".join(x + rnd.choice(["$$", "!!", "##"]) for x in w)))
        labels.append((i, y))
    return docs, labels


def test_features_count_words_and_grams():
    t = "Ab ab c"
    buf, off = T.text_buffer(pa.array([t, "", "ab"]))
    ids, owner = Q.features(buf, off, 18)
    assert np.bincount(owner, minlength=3).tolist() == [3 + 1 + 6 + 5 + 4, 0, 1 + 1]


def test_held_out_accuracy_and_score_formula(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(900, None), (901, ""), (None, docs[0][1]), (3, docs[3][1]), (902, "ok " * 40000)], "doc_id long, text string").withColumn("row", F.lit(0))
    y = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    got = Q.report(d, y).collect()
    assert len(got) == len(docs) + 5
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    model = Q.fit(d, y)
    again = {r.row.doc_id: r.score for r in Q.score(d, model).collect()}
    for i in (0, 1, 2):
        buf, off = T.text_buffer(pa.array([docs[i][1]]))
        ids, _ = Q.features(buf, off, model.bits)
        z = sum(float(model.weight[k]) for k in ids) / (len(ids) + Q.PAD) + model.bias
        assert abs(again[i] - 1 / (1 + np.exp(-z))) < 1e-6
    assert Q.good(d, y, model=model).columns == d.columns


def brute(docs, labels, bits, dim=4, epochs=2):
    """Features by slicing strings, and the gradient steps written out one feature at a time: a score a document."""
    import zlib
    from collections import Counter

    def count(t):
        b = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
        out = Counter()
        words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", b) if w]
        ids = [int(T.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 64 - bits for w in words]
        out.update(ids)
        for back in (1, 2):
            out.update(back for i in range(back, len(ids)) if ids[i] == ids[i - back])
        for n in Q.NGRAMS:
            for i in range(len(b) - n + 1):
                x = int.from_bytes(b[i : i + n], "big")
                x = (((x ^ x >> 15) * 0x2C1B3C6D + n) & 0xFFFFFFFF) * 0x297A2D39 & 0xFFFFFFFF
                out[x >> 32 - bits] += 1
        return out

    truth = dict(labels)
    rows = [(truth[d], sorted(count(t).items())) for d, t in docs if d in truth and zlib.crc32(str(d).encode()) % 3 != 1]
    rows = [(y, np.array([k for k, _ in f], np.int32), np.array([n for _, n in f], np.int32)) for y, f in rows if f]
    rows.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes(), r[2].tobytes()))
    rng = np.random.default_rng(Q.SEED)
    v = ((rng.random((1 << bits, dim), np.float32) - 0.5) / dim).astype(float)
    o, c, done = np.zeros((2, dim)), np.zeros(2), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, n = rows[k]
            lr = Q.RATE * (1 - done / (epochs * len(rows)))
            done += 1
            hidden = sum(x * v[i] for i, x in zip(ids, n)) / (n.sum() + Q.PAD)
            e = np.exp(o @ hidden + c)
            p = e / e.sum() - np.eye(2)[y]
            back = p @ o
            o, c = o - lr * np.outer(p, hidden), c - lr * p
            for i, x in zip(ids, n):
                v[i] -= lr * min(len(ids), 64) * x / (n.sum() + Q.PAD) * back
    out = []
    for d, t in docs:
        f = count(t)
        z = (o[1] - o[0]) @ (sum((n * v[i] for i, n in f.items()), np.zeros(dim)) / (sum(f.values()) + Q.PAD)) + c[1] - c[0]
        out.append((str(d), 1 / (1 + np.exp(-z))))
    return out


def test_scores_match_brute_force(spark):
    """Training and scoring over features counted one by one; a training text of more than 4096 distinct features is learned whole."""
    docs, labels = corpus(60)
    rnd = random.Random(4)
    docs[0] = (0, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1500)))
    docs += [(900, None), (901, ""), (None, "Delta Delta x"), (902, "\u4e2d a a b a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.fit(d, y, bits=14, dim=4, epochs=2)
    got = sorted((str(r.row.doc_id), r.score) for r in Q.score(d, model).collect())
    want = sorted(brute(docs, labels, 14))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_clashing_columns(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as label", "7 as quality", "1 as score", "2 as row", "3 as doc")
    y = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'z' as text", "0 as label")
    kept = Q.good(d, y)
    assert kept.columns == d.columns and {r.label for r in kept.collect()} == {"q"}
    assert Q.report(d, y).count() == 40 and Q.good(d.limit(0), y).count() == 0


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.report(d, y).collect()] == [0.5]
    assert Q.report(d.limit(0), y).count() == 0
