import math
import random
import re
import zlib
from collections import Counter

import pytest

from corpusq.llm import lm as L
from tests.llm.test_ppm import brute as code_length


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def test_scores_match_brute_force(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["The", "the", "cat", "é", "x1", f"rare{i % 13}", f"only{i}"]) for _ in range(rnd.randrange(0, 15)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "the secret"), (3, docs[3][1]), (102, "cat " * 3000)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    train = [t or "" for d, t in docs if d is not None and not held(d)]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in docs:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, base, -code_length(train, t or "") * math.log10(2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for head in (L.HEAD, 4):
        got = sorted((str(r.doc_id), *r[1:]) for r in L.report(df, head=head).collect())
        assert len(got) == len(want)
        for g, w in zip(got, sorted(want)):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)
    assert L.report(df.limit(0)).count() == 0


def test_every_context_counts(spark):
    """More order-3 contexts than the tree has by default, and a tree of hardly any, score as one that has them all."""
    rnd = random.Random(7)
    docs = [(i, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ 0123é") for _ in range(7000))) for i in range(14)]
    docs += [(100, docs[0][1][:900] + "new words ~ {}"), (None, ""), (101, "\u4e2d")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    train = [t for d, t in docs if d is not None and not held(d)]
    padded = [b"\0\0\0" + t.encode() for t in train]
    assert len({b[i : i + 3] for b in padded for i in range(len(b) - 2)}) > 24000
    want = {d: -code_length(train, t) * math.log10(2) for d, t in docs if d is None or d in (1, 9, 100, 101) or held(d)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in L.report(df).collect() if r.doc_id in want}
    assert got == {d: pytest.approx(x, rel=1e-5) for d, x in want.items()}
    few = {r.doc_id: r.score for r in L.report(df, contexts=50).collect() if r.doc_id in want}
    assert few == {d: pytest.approx(x, rel=1e-5) for d, x in want.items()}
