"""Centroid clustering by kd-tree filtering over whole numbers.

A vector counts if it has exactly ``dims`` components, none null, NaN or infinite; each component x becomes
floor(``scale`` * x).  Every task builds kd-trees over blocks of at most ``BLOCK`` vectors: a node has the number of its
vectors, their componentwise sums and their bounding box, all whole numbers.  The trees are written once and serve all
rounds.  A round sends the centroids (k of them, nothing that grows with the table) to the tasks and goes down each tree
level by level.  A node keeps those centroids that may be nearest to some point of its box: with s the candidate nearest
to the box's middle, z goes if it is strictly farther than s from the corner of the box that lies farthest towards z, and
so from all of the box; ties keep both.  A node with one candidate left is assigned whole, by its count and sum; leaves
are resolved by exact distances, the smaller number winning ties.  Each block gives at most k rows (count and sum), which
Spark adds up; new centroids are exact floors of the means, and a centroid without vectors stays.

Products are exact: components beyond ``LIMIT`` in size, of which squared distances need not fit 64 bits, are an
ArithmeticError, as overflow is in Spark's own arithmetic.  Below 2^22 sums of products stay below 2^53 and are made in
floating point, which is then exact too.

Defined cases: other vectors are left out; rows of equal vec_id, or of none, are vectors of their own; the first centroids
are the k vectors of smallest sha256 of ``1:<vec_id>`` (null vec_id last, then by components), so equal vectors may begin
several of them, of which the smallest number then takes all; fewer vectors than k give fewer centroids, no vector no row;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import cut, drop, prepare

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 1024, 16
LIMIT = 1 << 26
EXACT = 1 << 22


def build(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree over points[n, dims] (int64), nodes breadth first: order (places of the points, node by node), first, last,
    left (number of the left child, its sister follows; -1 for leaves), lo, hi, sums."""
    order = np.arange(len(points))
    first, last, left, boxes = [0], [len(points)], [], []
    i = 0
    while i < len(first):
        mine = points[order[first[i] : last[i]]]
        lo, hi = mine.min(0), mine.max(0)
        boxes.append((lo, hi, mine.sum(0)))
        axis = int(np.argmax(hi - lo))
        if len(mine) <= leaf or lo[axis] == hi[axis]:
            left.append(-1)
        else:
            half = len(mine) // 2
            order[first[i] : last[i]] = order[first[i] : last[i]][np.argpartition(mine[:, axis], half)]
            left.append(len(first))
            first += [first[i], first[i] + half]
            last += [first[i] + half, last[i]]
        i += 1
    lo, hi, sums = (np.array(x) for x in zip(*boxes))
    return {"order": order, "first": np.array(first), "last": np.array(last), "left": np.array(left), "lo": lo, "hi": hi, "sums": sums}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def nearest(points: np.ndarray, centroids: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point, the smallest of equals, and the squared distance."""
    d = (points * points).sum(1)[:, None] - 2 * product(points, centroids) + (centroids * centroids).sum(1)[None, :]
    if allowed is not None:
        d = np.where(allowed, d, np.iinfo(np.int64).max)
    best = d.argmin(1)
    return best, d[np.arange(len(points)), best]


def survivors(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of the centroids alive[node, k], those that no other is strictly nearer than in all of the node's box."""
    middle = lo + hi  # twice the middle, against twice the centroids
    s, _ = nearest(middle, 2 * centroids, alive)
    out = alive.copy()
    squares = (centroids * centroids).sum(1)
    for k in np.unique(s):
        mine = np.flatnonzero(s == k)
        u = centroids - centroids[k]
        towards = product(hi[mine], np.maximum(u, 0)) + product(lo[mine], np.minimum(u, 0))  # u . corner, for each centroid
        out[mine] &= squares[None, :] - squares[k] - 2 * towards <= 0
    out[np.arange(len(s)), s] = True
    return out


def assign(points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("nodes", nodes, clusters) for nodes that go whole, ("points", places, clusters) for what leaves resolve."""
    nodes = np.zeros(1, np.int64)
    alive = np.ones((1, len(centroids)), bool)
    while len(nodes):
        alive = survivors(tree["lo"][nodes], tree["hi"][nodes], centroids, alive)
        whole = alive.sum(1) == 1
        if whole.any():
            yield "nodes", nodes[whole], alive[whole].argmax(1)
        leaves = ~whole & (tree["left"][nodes] < 0)
        if leaves.any():
            at, size = tree["first"][nodes[leaves]], (tree["last"] - tree["first"])[nodes[leaves]]
            places = tree["order"][np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())]
            yield "points", places, nearest(points[places], centroids, np.repeat(alive[leaves], size, 0))[0]
        inner = ~whole & ~leaves
        down = tree["left"][nodes[inner]]
        nodes = np.stack([down, down + 1], 1).reshape(-1)
        alive = np.repeat(alive[inner], 2, 0)


def totals(points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sums of each centroid's vectors, by filtering."""
    count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for kind, which, cluster in assign(points, tree, centroids):
        np.add.at(count, cluster, (tree["last"] - tree["first"])[which] if kind == "nodes" else 1)
        np.add.at(sums, cluster, tree["sums"][which] if kind == "nodes" else points[which])
    return count, sums


def clusters(points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """The cluster of each vector, by filtering."""
    out = np.empty(len(points), np.int64)
    for kind, which, cluster in assign(points, tree, centroids):
        if kind == "nodes":
            for node, c in zip(which, cluster):
                out[tree["order"][tree["first"][node] : tree["last"][node]]] = c
        else:
            out[which] = cluster
    return out


def whole(column: str = "embedding", dims: int = DIMS) -> F.Column:
    """Whether a vector counts."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(column) == dims) & F.forall(column, fine), F.lit(False))


#: Arrays of a stored tree and their types.
STORED = {"points": "<i4", "order": "<i4", "first": "<i4", "last": "<i4", "left": "<i4", "lo": "<i4", "hi": "<i4", "sums": "<i8"}
BLOCKS = "vec_ids array<bigint>, " + ", ".join(f"{n} binary" for n in STORED)


def _plant(block: int, dims: int, scale: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids: list = []
        held: list[np.ndarray] = []

        def flush(n: int):
            points, rest = np.concatenate(held)[:n], np.concatenate(held)[n:]
            mine, ids[:] = ids[:n], ids[n:]
            held[:] = [rest] if len(rest) else []
            made = {"points": points} | build(points)
            stored = [pa.array([made[n].astype(t).tobytes()], pa.binary()) for n, t in STORED.items()]
            return pa.RecordBatch.from_arrays([pa.array([mine], pa.list_(pa.int64())), *stored], ["vec_ids", *STORED])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            if np.abs(x).max() * scale > LIMIT:
                raise ArithmeticError(f"components beyond {LIMIT // scale} have squared distances that need not fit 64 bits")
            ids += batch.column("vec_id").to_pylist()
            held.append(np.floor(scale * x).astype(np.int64))
            while len(ids) >= block:
                yield flush(block)
        if ids:
            yield flush(len(ids))

    return run


def trees(vectors: DataFrame, block: int = BLOCK, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row a block of vectors: vec_ids, points and the nodes of their tree, as little-endian integers."""
    prepare(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(whole(dims=dims)).mapInArrow(_plant(block, dims, scale), BLOCKS)


def _blocks(batch, dims: int) -> Iterator[tuple[list, np.ndarray, dict[str, np.ndarray]]]:
    for r in range(batch.num_rows):
        tree = {n: np.frombuffer(batch.column(n)[r].as_buffer(), t).astype(np.int64) for n, t in STORED.items()}
        for n in ("points", "lo", "hi", "sums"):
            tree[n] = tree[n].reshape(-1, dims)
        yield batch.column("vec_ids")[r], tree.pop("points"), tree


def _sum(sent, dims: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = np.array(sent.value, np.int64)
        for batch in batches:
            count, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for _, points, tree in _blocks(batch, dims):
                n, s = totals(points, tree, c)
                count, sums = count + n, sums + s
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _label(sent, dims: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = np.array(sent.value, np.int64)
        for batch in batches:
            for ids, points, tree in _blocks(batch, dims):
                of = clusters(points, tree, c)
                d = ((points - c[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(of, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE) -> list[list[int]]:
    """The first k vectors by sha256, as whole numbers."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("bigint").cast("string")), 256)
    whole_numbers = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("bigint"))
    top = vectors.where(whole(dims=dims)).select(h.alias("h"), whole_numbers.alias("c")).orderBy(F.col("h").asc_nulls_last(), "c").limit(k)
    return [list(r.c) for r in top.collect()]


def step(blocks: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> list[list[int]]:
    """The centroids after a round: exact floors of the means; k rows come to the driver."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)
    parts = blocks.mapInArrow(_sum(sent, dims), "cluster int, n bigint, sums array<bigint>")
    adds = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *adds).collect():
        if r.n:
            out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, block: int = BLOCK, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that counts, the last centroids)."""
    blocks = cut(trees(vectors, block, dims, scale))
    centroids = seeds(vectors, k, dims, scale)
    if centroids:
        for _ in range(rounds):
            centroids = step(blocks, centroids, dims)
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)
    out = cut(blocks.mapInArrow(_label(sent, dims), "vec_id bigint, cluster int, distance bigint"))
    drop(blocks)
    return out, centroids


def report(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    out, centroids = cluster(vectors, k, rounds)
    spark = vectors.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), h) for i, h in names]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS b FROM (
      SELECT v.r, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{n} c) GROUP BY r)"""


def _moved(n: int) -> str:
    return f"""m{n} AS (SELECT k, i, (s - ((s % c) + c) % c) // c AS m FROM (
      SELECT a.b.k AS k, i, sum(v.x[i])::BIGINT AS s, count(*) AS c FROM a{n} a JOIN v USING (r), range(1, 65) t(i) GROUP BY a.b.k, i)),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT k, list(m ORDER BY i) AS x FROM m{n} GROUP BY k) m USING (k))"""


#: The same as DuckDB SQL, by plain assignment to all centroids.
SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v QUALIFY k < 16),
{", ".join(f"{_assigned(n)}, {_moved(n)}" for n in range(ROUNDS))}, {_assigned(ROUNDS)}
SELECT v.vec_id, CAST(a.b.k AS INTEGER) AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.k))::BIGINT AS cluster_inertia, (sum(a.b.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (r) JOIN c{ROUNDS} c ON c.k = a.b.k
"""
