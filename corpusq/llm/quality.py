"""Quality classifier with supervised subword embeddings.

Features of a text (A-Z lower-cased): its words ``[^\\x20\\x09-\\x0D]+`` and the byte n-grams of sizes ``NGRAMS``
over the whole text, hashed to ``2 ** bits`` buckets, and a mark for every word that repeats the one or two words
before.  Each bucket has a learned vector; a document is the average of its features' vectors and of ``PAD`` zero
vectors, which keep few features from deciding much, and a softmax over two classes gives the score of label 1.  Vectors and output weights are
trained by stochastic gradient descent in numpy.

The classifier is fitted on a bounded sample of labelled rows: of each label at most about ``per_label`` documents,
taken by the hash of doc_id, each with all its features.  The sample goes to one task, which returns the trained model
as one row, so the driver holds one float a bucket and never the sample.  A trained document score is a weighted mean of
one number a bucket, so scoring gathers one float a feature and moves no rows.

Defined cases: a null or empty text has no features and gets the score of the learned bias alone; with no
labelled rows every score is 0.5; null labels and labels other than 0 and 1 are ignored, and of several labels of a
doc_id the largest counts; repeated documents are separate rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import text as T
from corpusq.llm.common import columns, fold, prepare, rows_of

BITS, DIM, NGRAMS, PER_LABEL, EPOCHS, RATE, SEED, PAD = 18, 16, (2, 3, 4), 1500, 6, 0.5, 17, 100


@dataclass
class Model:
    weight: np.ndarray  # one number a bucket
    bias: float
    bits: int


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of a slice, and its document."""
    starts, ends, cum = T.spans(buf, offsets, T.NONSPACE)
    docs = len(offsets) - 1
    shift = np.uint64(64 - bits)
    ids = [(T.hash_spans(buf, starts, ends) >> shift).astype(np.int32)]
    owner = [np.repeat(np.arange(docs, dtype=np.int32), np.diff(cum))]
    for back in (1, 2):
        again = np.flatnonzero((ids[0][back:] == ids[0][:-back]) & (owner[0][back:] == owner[0][:-back])) + back
        ids.append(np.full(len(again), back, np.int32))
        owner.append(owner[0][again])
    low = T.LOWER[buf].astype(np.uint32)
    doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(offsets))
    for n in NGRAMS:
        m = len(low) - n + 1
        if m <= 0:
            continue
        code = low[:m].copy()
        for j in range(1, n):
            code = code << np.uint32(8) | low[j : j + m]
        code = ((code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(n)) * np.uint32(0x297A2D39)
        inside = doc[:m] == doc[n - 1 :]
        ids.append((code[inside] >> np.uint32(32 - bits)).astype(np.int32))
        owner.append(doc[:m][inside])
    return np.concatenate(ids), np.concatenate(owner)


def _counts(bits: int) -> callable:
    """(label, text) to (label, ids, counts): the distinct features of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, counts = [], []
            for a, b, buf, offsets in T.text_slices(batch.column("text"), 1 << 16):
                f, owner = features(buf, offsets, bits)
                key, n = np.unique(owner.astype(np.int64) << bits | f, return_counts=True)
                cuts = np.searchsorted(key >> bits, np.arange(b - a + 1))
                for i in range(b - a):
                    ids.append((key[cuts[i] : cuts[i + 1]] & ((1 << bits) - 1)).astype(np.int32))
                    counts.append(n[cuts[i] : cuts[i + 1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["label", "ids", "counts"])

    return run


def _train(bits: int, options: dict) -> callable:
    """(label, ids, counts), in one task, to the trained model as one row (weight, bias)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: list[tuple] = []
        for batch in batches:
            lists = [batch.column(c) for c in ("ids", "counts")]
            (ids, cuts), (counts, _) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in lists)
            rows += [(y, ids[cuts[i] : cuts[i + 1]].copy(), counts[cuts[i] : cuts[i + 1]].copy()) for i, y in enumerate(batch.column("label").to_pylist())]
        rows.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes(), r[2].tobytes()))
        model = train(rows, bits, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weight", "bias"])

    return run


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Averaged embeddings and a softmax output by stochastic gradient descent over (label, ids, counts)."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << bits, dim), np.float32) - 0.5) / dim
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    rows = [(y, i, (c / (c.sum() + PAD)).astype(np.float32)) for y, i, c in rows if len(i)]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, share = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            own = vectors[ids]
            hidden = share @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * p
            # As each feature's step is shared by all of the document's, it is scaled up to the document's size.
            vectors[ids] = own - (lr * min(len(ids), 64)) * share[:, None] * back[None, :]
    direction = out[1] - out[0]
    return Model((vectors @ direction).astype(np.float32), float(bias[1] - bias[0]), bits)


def sample(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, folds: int = 3, held: int = 1) -> DataFrame:
    """(label, text) of training rows: about ``per_label`` documents of each label at most, by the hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for y, k in n.items():
        share = F.when(F.col("label") == y, F.lit(min(1.0, per_label / k))).otherwise(share)
    # The sample is bounded by per_label, so it may be broadcast.
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return documents.where(fold("doc_id", folds) != held).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, bits: int = BITS, **options) -> Model:
    prepare(documents.sparkSession)
    rows = sample(documents, labels, label, per_label).mapInArrow(_counts(bits), "label int, ids array<int>, counts array<int>")
    # One row at most: a task without rows still returns the untrained model.
    got = rows.repartition(1).mapInArrow(_train(bits, options), "weight binary, bias double").first()
    return Model(np.frombuffer(got.weight, np.float32), got.bias, bits) if got else train([], bits, **options)


def _score(sent) -> callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(**sent.value)
        for batch in batches:
            found = [np.zeros(0)]
            for a, b, buf, offsets in T.text_slices(batch.column("text")):
                f, owner = features(buf, offsets, model.bits)
                n = np.bincount(owner, minlength=b - a)
                s = np.bincount(owner, model.weight[f].astype(np.float64), minlength=b - a)
                z = s / (n + PAD) + model.bias
                found.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found))], ["row", "score"])

    return run


def score(documents: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(row, score) for every document; row is a struct of the kept columns."""
    spark = prepare(documents.sparkSession)
    docs = documents.select(F.struct(*(keep or (F.col("doc_id"),))).alias("row"), "text")
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(vars(model))), rows_of(docs, "score double"))


def report(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    model = fit(documents, labels)
    got = score(documents, model)
    doc_id = F.col("row.doc_id")
    return got.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(documents: DataFrame, labels: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    model = model or fit(documents, labels)
    return score(documents, model, F.struct(*columns(documents)).alias("doc")).where(F.col("score") >= least).select("row.doc.*")
