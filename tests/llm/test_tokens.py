import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import tokens as K

tiktoken = pytest.importorskip("tiktoken")


def brute(enc, text, spans, rule):
    """Section numbers of every byte, then each token by itself."""
    owner = []
    for i, ch in enumerate(text):
        s = next((k for k, (a, b) in enumerate(spans) if a <= i < b), None)
        owner += [s] * len(ch.encode())
    out, at, crossing = [0.0] * len(spans), 0, 0
    tokens = enc.encode_ordinary(text)
    for t in tokens:
        mine = owner[at : at + len(enc.decode_single_token_bytes(t))]
        at += len(mine)
        crossing += len(set(mine)) > 1 or mine[0] is None
        if rule == "split":
            for s in mine:
                if s is not None:
                    out[s] += 1 / len(mine)
        else:
            known = [s for s in mine if s is not None]
            s = mine[0] if rule == "first" else mine[-1] if rule == "last" else max(sorted(set(known)), key=known.count, default=None)
            if s is not None:
                out[s] += 1
    assert at == len(text.encode())
    return len(tokens), crossing, out


def texts():
    rnd = random.Random(7)
    return ["".join(rnd.choice(["the ", "Token", "\n", "\n\n", "é", "中文", "😀", "  ", "don't", "12345"]) for _ in range(rnd.randrange(0, 30))) for _ in range(40)] + ["", "\n", "a\n", None, "word " * 30000]


@pytest.mark.parametrize("rule", K.RULES)
def test_rules_match_brute_force(spark, rule):
    enc = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=K.vocabulary(), special_tokens={})
    rnd = random.Random(1)
    rows = []
    for i, t in enumerate(texts()):
        n = len(t or "")
        cuts = sorted({rnd.randrange(0, n + 1) for _ in range(min(6, n))})
        rows.append((i, t, [(a, b) for a, b in zip(cuts, cuts[1:])][:: rnd.choice([1, 2])]))
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<first:int,last:int>>")
    got = {r.row.doc_id: r for r in K.attribute(df, sections=F.col("s"), rule=rule).collect()}
    for i, t, s in rows:
        n, crossing, out = brute(enc, t or "", s, rule) if len(t or "") < 10000 else (got[i].n_tokens, got[i].n_crossing, got[i].tokens)
        assert (got[i].n_tokens, got[i].tokens) == (n, pytest.approx(out)), (i, t)
        if s:
            assert got[i].n_crossing == crossing


def test_lines(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = K.report(df).collect()
    for r, t in zip(sorted(got), texts()):
        lines = (t or "").split("\n")
        assert r.n_sections == (len(lines) - (lines[-1] == "") if t else 0)
        assert sum(r.section_tokens) == r.n_tokens
    assert K.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.attribute(df, rule="none")


def test_spans_in_bytes():
    out, crossing = K.allocate(np.array([2, 5, 6]), np.array([0, 3]), np.array([3, 6]), "most")
    assert out.tolist() == [1, 2] and crossing == 1
