"""op13: filtering by kd-trees against plain assignment."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import kdtree as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=T.K, rounds=T.ROUNDS, dims=T.DIMS):
    kept = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [list(e) for _, e in first[:k]]
    def of(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, e in kept:
            groups.setdefault(of(e)[1], []).append(e)
        for i, g in groups.items():
            centers[i] = [sum(x) // len(g) for x in zip(*g)]
    got = [(i, *of(e)[::-1]) for i, e in kept]
    sums = {}
    for _, c, d in got:
        sums[c] = sums.get(c, 0) + d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in got), key=str)


def made(n, seed, scale=1.0, groups=5):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, 64)) * scale
    return [(i, [float(x) for x in np.float32(middle[i % groups] + rnd.normal(size=64) * scale * rnd.choice([0, 0.1, 1]))], 0) for i in range(n)]


def same(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"cluster": F.lit("clash"), "distance": F.lit(1), "points": F.lit(2)})
    assert sorted((tuple(r) for r in T.report(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.02), (3, 40.0)])
def test_agrees_with_plain_assignment(spark, seed, scale):
    same(spark, made(300, seed, scale))


def test_ties_nulls_and_odd_vectors(spark):
    rows = made(60, 4)
    ok = rows[0][1]
    odd = [(None, ok, None), (None, [0.5] * 64, 1), (7, ok, 1), (7, ok, 1), (100, None, 1), (101, [], 1), (102, ok[:63], 1), (103, [*ok, 1.0], 1), (104, [*ok[:63], None], 1), (105, [*ok[:63], float("nan")], 1), (106, [*ok[:63], float("-inf")], 1), (107, [0.0] * 64, 1), (108, [-0.001] * 64, 1)]
    same(spark, rows + odd + [(1000 + i, ok, 0) for i in range(200)])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    same(spark, made(n, 5))


def test_values_beyond_exact_floating_point(spark):
    rows = made(80, 6, 200_000.0)
    assert max(abs(x) for _, e, _ in rows for x in e) * 64 > T.EXACT
    same(spark, rows)


def test_values_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        T.report(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()


def test_whole_nodes_are_assigned_and_blocks_are_many(spark):
    rows = made(400, 7, 1.0)
    points = np.floor(64 * np.array([e for _, e, _ in rows])).astype(np.int64)
    tree = T.build(points)
    centers = np.array([points[i] for i in range(5)])
    kinds = [kind for kind, _, _ in T.assign(points, tree, centers)]
    assert "nodes" in kinds
    assert (T.clusters(points, tree, centers) == T.nearest(points, centers)[0]).all()
    count, sums = T.totals(points, tree, centers)
    of = T.nearest(points, centers)[0]
    assert (count == np.bincount(of, minlength=5)).all() and all((sums[c] == points[of == c].sum(0)).all() for c in range(5))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert T.trees(df, block=50).count() == 8
    out, _ = T.cluster(df, block=50)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out.collect()) == [r[:3] for r in sorted(brute(rows))]


def test_query_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no sample tables")
    want = duckdb.sql(f"WITH embeddings AS (FROM '{data}/embeddings.parquet'), " + T.SQL.strip().removeprefix("WITH ")).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in T.report(spark.read.parquet(f"{data}/embeddings.parquet")).collect())
