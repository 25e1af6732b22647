"""Exact nearest neighbours over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def clean(vector: Column) -> Column:
    """Doubles, with null, NaN and infinities as 0."""
    return F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return dot(a, b)


def score(d: Column, metric: str, profile: str = "local") -> Column:
    """Distances as scores: cosine 1 - d/2 locally and 1 - d in the cloud, l2 1 / (1 + d), dot as it is."""
    if metric == "cosine":
        return 1 - d if profile == "cloud" else 1 - d / 2
    if metric == "l2":
        return 1 / (1 + d)
    return d if metric == "dot" else 1 - d


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", profile: str = "local", where: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k best rows by score; filters come first."""
    if k <= 0:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("score", score(distance(clean(F.col(vector)), literal(query), metric), metric, profile)).where(F.col("score").isNotNull())
    return scored.orderBy(F.round("score", 9).desc(), key).limit(k)


def knn_post_filter(rows: DataFrame, query: list[float], k: int, where: Column, metric: str = "cosine", least: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Filter the best 2k; if fewer than ``least`` (k) survive, the best 2k of the filtered rows instead; then k of them."""
    best = knn(rows, query, 2 * k, metric, vector=vector, key=key).where(where)
    enough = best.agg(F.count("*").alias("__n"))
    first = best.crossJoin(F.broadcast(enough)).where(F.col("__n") >= max(1, k if least is None else least)).drop("__n")
    second = knn(rows, query, 2 * k, metric, where=where, vector=vector, key=key).crossJoin(F.broadcast(enough)).where(F.col("__n") < max(1, k if least is None else least)).drop("__n")
    return first.unionByName(second).orderBy(F.round("score", 9).desc(), key).limit(k)


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of doubles; null, NaN and infinities are 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(column) and pc.min_max(column.value_lengths()).as_py() != {"min": width, "max": width}:
        raise ValueError(f"vectors must have {width} components")
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.nan_to_num(values.reshape(-1, width), nan=0.0, posinf=0.0, neginf=0.0)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        return 1 - (1 - s / np.maximum(np.linalg.norm(x, axis=1)[None, :], 1e-300)) / 2
    if metric == "l2":
        return 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s, 0)))
    return s


class _Best:
    """The k best (query, score, key) of each of n queries, by score rounded to 9 digits, then key."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held = k, np.full(n, -np.inf), None

    def add(self, s: np.ndarray, keys: np.ndarray) -> None:
        """s: scores by query and key, -inf where there is none.  Those below a query's k-th score so far, or of these, are left out before any sort."""
        least = self.least
        if np.isneginf(least).any() and s.shape[1] > self.k:
            least = np.maximum(least, np.round(np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k], 9))
        query, at = np.nonzero((s >= least[:, None] - 2e-9) & (s > -np.inf))
        if not len(query):
            return
        query, score, key = query, s[query, at], keys[at]
        if self.held:
            query, score, key = (np.concatenate(x) for x in zip(self.held, (query, score, key)))
        order = np.lexsort((key, -np.round(score, 9), query))
        query, score, key = query[order], score[order], key[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.held = query[keep], score[keep], key[keep]
        last = rank == self.k - 1
        self.least[query[last]] = np.round(score[last], 9)


def knn_many(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", block: int = 1024) -> DataFrame:
    """(query_id, key, score, rank): the k best rows for every query(query_id, vector).

    Queries go out in blocks of ``block``; each task keeps its k best of each query, and only those are shuffled.  Rows are
    scored ``block`` at a time, so a task holds block * block scores and k rows a query.  As in ``knn``, components that
    are no numbers count as 0, and by cosine a vector without length matches nothing.
    """
    asked = queries.select("query_id", "vector").toLocalIterator()
    sc = rows.sparkSession.sparkContext
    found, held = None, []
    kinds = [to_arrow_type(t) for t in (queries.schema["query_id"].dataType, rows.schema[key].dataType)]

    def run_block(part: list) -> DataFrame:
        ids = np.array([r.query_id for r in part])
        matrix = np.nan_to_num(np.array([r.vector for r in part], np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        if metric == "cosine":
            long = np.linalg.norm(matrix, axis=1) > 0
            ids, matrix = ids[long], matrix[long]
        sent = sc.broadcast((ids, matrix))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            ids, q = sent.value
            if metric == "cosine":
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best = _Best(len(ids), k)
            for part in (b.slice(i, block) for b in batches for i in range(0, b.num_rows, block)):
                keys, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), q.shape[1])
                if metric == "cosine":
                    long = np.linalg.norm(x, axis=1) > 0
                    keys, x = keys[long], x[long]
                if len(x) and len(ids):
                    best.add(_scores(q, x, metric), keys)
            if best.held:
                at, score, found = best.held
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], kinds[0]), pa.array(found, kinds[1]), pa.array(score)], ["query_id", key, "score"])

        return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double")

    for r in asked:
        held.append(r)
        if len(held) == block:
            found = run_block(held) if found is None else found.unionByName(run_block(held))
            held = []
    if held or found is None:
        empty = rows.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), key, F.lit(0.0).alias("score")).limit(0)
        last = run_block(held) if held else empty
        found = last if found is None else found.unionByName(last)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
