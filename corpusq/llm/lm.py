"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram base.

Score: log10 probability of the text and its end under the frozen context trees of ``ppm``, counted over every
training text.  Base: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end token; a token's probability is
(c + 0.1) / (N + 0.1 (V + 1)) with training counts c, N of all tokens, V of distinct ones.

Words are told apart by a 64-bit hash.  Counts are combined in the map task before they are shuffled.  The most
frequent words, about ``HEAD`` at most, are broadcast and looked up where the text is read; only a document's other
words are shuffled, joined with their counts and summed up by document, so no key is hot: a word frequent in the
training texts is never shuffled.

The tree grows with the training texts in the same way.  All contexts of orders 0 to 2, at most 65793 whatever the
corpus, and the most frequent ones of order 3, about ``CONTEXTS`` at most, are broadcast.  A document's symbols in other
order-3 contexts are shuffled, once each with their number, and joined with their costs, which are taken from the
counts of all contexts.

Defined cases: a null or empty text is its end token alone; a document of null doc_id is scored, not learned from;
with nothing learned every symbol costs 8 bits and V = N = 0; repeated documents are separate rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import ppm
from corpusq.llm import text as T
from corpusq.llm.common import cut, fold, prepare, rows_of

HEAD = 1 << 20
CONTEXTS = ppm.ORDER3
LOG2 = float(np.log10(2))


def _counts(batches: Iterator) -> Iterator:
    """(text) to (kind, key, n): words by hash (kind 0) and symbols with three bytes before them (kind 1)."""
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        for _, _, buf, offsets in T.text_slices(batch.column("text")):
            starts, ends, _ = T.spans(buf, offsets, T.NONSPACE)
            ppm.add(held, 0, T.hash_spans(buf, starts, ends))
            ppm.add(held, 1, ppm.codes(buf, offsets)[0])
    for kind, parts in held.items():
        keys, n = ppm.tally(parts)
        keys = keys.view(np.int64) if kind == 0 else keys.astype(np.int64)
        for a in range(0, len(keys), 1 << 16):
            k = keys[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[a : a + (1 << 16)])], ["kind", "key", "n"])


def _score(sent, total: int, distinct: int, ends: int) -> callable:
    """(row, text) to (row, at, n_tokens, known, base, score, rest, far).

    rest holds the hashes of words outside the head, far the symbols (with their contexts) outside the tree.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        state, keys, counts = sent.value
        model = ppm.Model(**state)
        states = model.states()
        deep = 257 + len(model.two)
        logs = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        end = float(np.log10((ends + 0.1) / (total + 0.1 * (distinct + 1))))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, known, base, score, rest, far = [], [], [], [], [], []
            for a, b, buf, offsets in T.text_slices(batch.column("text")):
                docs = b - a
                starts, stops, cum = T.spans(buf, offsets, T.NONSPACE)
                words, back = np.unique(T.hash_spans(buf, starts, stops), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
                hit = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                cost = np.where(hit, logs[at] if len(keys) else 0.0, 0.0)[back]
                inside = hit[back]
                doc = np.repeat(np.arange(docs), np.diff(cum))
                n.append(np.diff(cum) + 1)
                known.append(np.bincount(doc, inside, docs).astype(np.int64) + (ends > 0))
                base.append(np.bincount(doc, cost, docs) + end)
                out = np.flatnonzero(~inside)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[out], minlength=docs))]).astype(np.int32)
                rest.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(words[back[out]].view(np.int64))))
                code, edges = ppm.codes(buf, offsets)
                node = states[code >> np.uint32(8)].astype(np.int64)
                cost = np.where(node >= deep, model.cost[0][node << 8 | (code & np.uint32(255))].astype(np.float64), 0.0)
                score.append(-LOG2 * np.add.reduceat(cost, edges[:-1]))
                out = np.flatnonzero(node < deep)
                doc = np.searchsorted(edges, out, "right") - 1
                pairs, times = np.unique(doc.astype(np.uint64) << np.uint64(32) | code[out], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(docs + 1).astype(np.uint64) << np.uint64(32)).astype(np.int32)
                symbols = [pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times.astype(np.int64))]
                far.append(pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(symbols, ["code", "n"])))
            if not n:
                continue
            ids = row + np.arange(batch.num_rows)
            row += batch.num_rows
            cols = [np.concatenate(x) for x in (n, known, base, score)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids), *(pa.array(c) for c in cols), pa.concat_arrays(rest), pa.concat_arrays(far)], ["row", "at", "n_tokens", "known", "base", "score", "rest", "far"])

    return run


def learn(training: DataFrame) -> DataFrame:
    """Counts (kind, key, n) over all training texts."""
    prepare(training.sparkSession)
    rows = training.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counts, "kind int, key bigint, n bigint")
    return cut(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def scores(documents: DataFrame, training: DataFrame, *keep: Column, head: int = HEAD, contexts: int = CONTEXTS) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) for every document; row is a struct of the kept columns."""
    spark = prepare(documents.sparkSession)
    counts = learn(training)
    ends = training.count()
    words = counts.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    table = ppm.frequent(words.withColumn("total", F.col("n")), head).toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    symbols = counts.where("kind = 1").select(F.lit("").alias("label"), F.col("key").alias("code"), "n")
    model = ppm.build(symbols, contexts, ppm.ALL2, keep=True)
    sent = spark.sparkContext.broadcast((vars(model) | {"seen": None}, keys[order], table["n"].to_numpy()[order]))
    docs = documents.select(F.struct(*(keep or (F.col("doc_id"),))).alias("row"), "text")
    schema = rows_of(docs, "at bigint, n_tokens bigint, known bigint, base double, score double, rest array<bigint>, far array<struct<code:bigint,n:bigint>>")
    docs = cut(docs.mapInArrow(_score(sent, total, distinct, ends), schema))
    rest = docs.select("at", F.explode("rest").alias("key")).join(words, "key", "left")
    cost = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (total + 0.1 * (distinct + 1)))
    rest = rest.groupBy("at").agg(F.sum(cost).alias("more"), F.count("n").alias("seen"))
    far = docs.select("at", F.explode("far").alias("f")).select("at", "f.code", "f.n")
    context = F.shiftright("code", 8).alias("context")
    follow = symbols.groupBy(context).agg(F.collect_list(F.struct(F.col("code").bitwiseAND(255).cast("int").alias("symbol"), "n")).alias("next"))
    asked = far.select("code").distinct().withColumn("context", context).join(follow, "context", "left").select("code", "next")
    costs = cut(asked.mapInArrow(ppm.beyond(spark.sparkContext.broadcast((model.two, model.seen))), "code bigint, bits double"))
    far = far.join(costs, "code").groupBy("at").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    out = docs.drop("rest", "far").join(rest, "at", "left").join(far, "at", "left")
    return out.select("row", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") - LOG2 * F.coalesce("bits", F.lit(0.0))).alias("score"))


def report(documents: DataFrame, folds: int = 10, held: int = 0, head: int = HEAD, contexts: int = CONTEXTS) -> DataFrame:
    got = scores(documents, documents.where(fold("doc_id", folds) != held), head=head, contexts=contexts)
    doc_id = F.col("row.doc_id")
    return got.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
