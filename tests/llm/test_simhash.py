import random

import numpy as np

from corpusq.llm import components as C
from corpusq.llm import simhash as S


def test_links_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = [int(c) for c in centres]
    for c in centres:
        for _ in range(10):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    pairs = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i] if (int(a) ^ int(b)).bit_count() <= 3}
    by_key = {(int(a), int(b)) for a, b in pairs if any((a & m) == (b & m) for m in S.masks())}
    assert by_key == pairs
    u, v = S.links(np.zeros(len(fp), int), fp)
    want = {int(x) for p in pairs for x in p}
    assert {int(x) for x in np.concatenate([u, v])} == want


def test_classes_match_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"W{i}" for i in range(300)]
    docs = []
    for i in range(25):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 150))]
        docs.append((10 * i + 7, " ".join(w)))
        for j in range(rnd.randrange(0, 4)):
            x = list(w)
            x[rnd.randrange(len(x))] = "new"
            docs.append((10 * i + 6 - j, "\n".join(x)))
    docs += [(900, None), (901, ""), (902, " \t"), (903, docs[0][1]), (7, docs[0][1]), (None, "alone in the dark"), (None, docs[3][1]), (950, "x y " * 20000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": S.F.lit("clash"), "row": S.F.lit(1), "component_id": S.F.lit(2), "__id": S.F.lit(3), "h": S.F.lit(4)})
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    want = sorted(S.brute(docs), key=key)
    for hot in (1024, 3):
        got = S.classes(d, hot=hot).select("row.doc_id", S.hex16(S.F.col("fp")).alias("f"), "component_id").collect()
        assert sorted((tuple(r) for r in got), key=key) == want
    kept = S.one_each(d)
    assert kept.columns == d.columns
    assert kept.count() == len({c for _, _, c in want if c is not None}) + len({f for _, f, c in want if c is None})
    assert {r.doc_id for r in kept.collect()} - {None} == {c for _, _, c in want if c is not None}
    assert S.one_each(d.limit(0)).count() == 0


def test_one_of_each_class(spark):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randrange(200)) for _ in range(2500)) for _ in range(4)]
    fp = lambda t: int(S.brute([(1, t)])[0][1], 16)
    words = base[0].split()
    near = next(t for t in (" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 2500, 7)) if 1 <= (fp(t) ^ fp(base[0])).bit_count() <= 3)
    docs = [(None, base[0]), (None, near), (None, base[0]), (5, base[1]), (4, base[1]), (4, base[1]), (6, base[2]), (None, base[2]), (7, None), (8, ""), (9, base[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in S.one_each(d).collect())
    assert [i for i, _ in got] == [0, 4, 6, 7, 9] and got[0][1] in (base[0], near)
    # Texts that share their identity stay apart by doc_id.
    same = S.one_each(d.where("doc_id is not null"), identity_of=lambda text: S.F.unhex(S.F.lit("01")))
    assert sorted(r.doc_id for r in same.collect()) == [4, 6, 7, 9]


def test_long_chain_is_one_component(spark):
    e = spark.range(200).selectExpr("id as u", "id + 1 as v")
    got = C.roots(e).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}
