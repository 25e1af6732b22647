import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from corpusq.llm import sketch as K


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(max(1, len(h) - K.SHINGLE + 1) if h else 0):
        seed = 42
        for x in h[i : i + K.SHINGLE]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        out.add(signed(seed))
    low = {x for x in out if x < -(1 << 63) + (1 << 64) // K.SCALE}
    return sorted(low or {min(out)}) if out else []


def like(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def rows(n, seed=1):
    rnd = random.Random(seed)
    docs = [(rnd.randrange(-(10**12), 10**12), " ".join(rnd.choice(["aé", "B", "c\n", "dd", "中文"]) + str(rnd.randrange(30)) for _ in range(rnd.randrange(0, 80)))) for _ in range(n)]
    return list({d: (d, t) for d, t in docs}.values())


def check(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sketch", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in K.report(df).collect()}
    assert len(got) == len(docs)
    order = sorted(docs, reverse=True)
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        r = got[d]
        a, b, c = brute(t), brute(e), brute(u)
        text = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b))
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12


def test_report_matches_brute_force(spark, monkeypatch):
    check(spark, rows(120))
    for options in ({"bucket_rows": 7}, {"bucket_rows": 7, "sample": 40}, {"bucket_rows": 2, "buckets": 9}):
        monkeypatch.setattr(K.neighbours, "__kwdefaults__", K.neighbours.__kwdefaults__ | options)
        check(spark, rows(150, 2))
    check(spark, [(5, "only one here"), (2, "x " * 20000)])
    check(spark, [(5, "alone")])


def test_next_of_null_and_equal_ids(spark):
    """Rows of no or one doc_id stand in the order of their texts' hashes, over many buckets."""
    docs = [(None, f"none {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(8, "last"), (-3, "x"), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    keyed = [(r.k, r.doc_id, r.text) for r in df.select(K.place(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text").collect()]
    order = [(d, t) for _, d, t in sorted(keyed, key=lambda x: x[0])]
    assert [d for d, _ in order] == [8] + [7] * 61 + [-3] + [None] * 60
    got = {(r.doc_id, r.text): (r.next.doc_id, r.next.text) for r in K.neighbours(df, "doc_id", "text", bucket_rows=4).collect()}
    assert got == dict(zip(order, order[1:] + order[:1]))
    twice = df.where("doc_id is null").unionByName(df.where("doc_id is null"))
    assert K.neighbours(twice, "doc_id", "text", bucket_rows=4).count() == 120


def test_nulls_ties_and_merging(spark):
    df = spark.createDataFrame([(1, None), (1, "a b"), (1, "a b"), (None, "x"), (None, None), (2, " ")], "doc_id long, text string")
    assert K.report(df).count() == 6
    assert K.report(df.limit(0)).count() == 0
    two = spark.createDataFrame([(r[1], s[1]) for r, s in zip(rows(40), rows(40, 9))], "a string, b string")
    m = two.select(K.merge(K.sketch(F.col("a")), K.sketch(F.col("b"))).alias("m"), "a", "b").collect()
    for r in m:
        u = sorted(set(brute(r.a)) | set(brute(r.b)))
        low = [x for x in u if x < -(1 << 63) + (1 << 64) // K.SCALE]
        assert r.m == (low or u[:1])
