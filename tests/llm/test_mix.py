import random

from pyspark.sql import functions as F

from corpusq.llm import mix as M


def highest(tau, total):
    got = [0] * len(tau)
    for _ in range(total):
        i = max(range(len(tau)), key=lambda i: (tau[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_quotas_are_those_of_highest_quotients(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        raw = [rnd.random() ** 3 * 50 for _ in range(rnd.randrange(1, 30))]
        total = round(sum(raw)) if g % 2 else int(sum(raw)) + 1
        tau = [x * total / sum(raw) for x in raw]
        want |= {(g, i): n for i, n in enumerate(highest(tau, total))}
        rows += [(g, i, t, total) for i, t in enumerate(tau)]
    df = spark.createDataFrame(rows, "g int, i int, tau double, total long")
    got = {(r.g, r.i): r.blocks for r in M.quotas(df, "tau", "total", ["i"], ["g"]).collect()}
    assert got == want


def test_targets_taken_and_defined_cases(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join("w" * 3 for _ in range(rnd.randrange(0, 60))), rnd.choice(["a", "b", "c", "dé", None, "z"])) for i in range(400)]
    docs += [(1, docs[1][1], docs[1][2]), (900, None, "a"), (901, " \n", None), (None, "x y", "q"), (902, None, "empty"), (903, "k " * 30000, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = M.mix(df, F.col("doc_id"), F.col("source")).select("row.*", "size", "source_size", "target", "taken")
    got = out.collect()
    assert len(got) == len(docs)
    total = sum(r["size"] for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6 * total
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.taken
    target = {r.source: r.target for r in got}
    assert all(abs(by[s] - target[s]) <= 2 * M.BLOCK for s in by)
    assert sorted(map(str, got)) == sorted(map(str, out.collect()))
    assert M.mix(df.limit(0)).count() == 0


def test_rows_without_an_id_are_dealt_out(spark):
    df = spark.range(6000).selectExpr("cast(null as long) as doc_id", "concat('w ', id) as text", "'s' as source")
    rows = M.mix(df, F.col("text")).collect()
    assert len(rows) == 6000 and sum(r.taken for r in rows) == 12000
    same = df.withColumn("doc_id", F.lit(3).cast("long"))
    h = F.md5(F.concat_ws(":", F.lit(M.SEED), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    assert same.select(h.alias("h")).distinct().count() == 6000
