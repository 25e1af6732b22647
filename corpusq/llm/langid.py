"""Language identification by prediction by partial matching: the language whose context tree codes the text shortest.

Trees are learned from a bounded sample of rows with a language, about ``per_lang`` documents of each at most, taken
by the hash of doc_id; whole texts count, and a tree holds every context of its sample, however many languages there
are (about 1 MB a language).  Every document is scored under every tree (see ``ppm``), each distinct symbol and context
of a slice of documents once; the score is the posterior of the best language, all being equally likely beforehand.

Defined cases: ``und`` with score 0 for a null text, a text without letters, or when nothing could be learned; ties
go to the first language in code-point order; repeated documents are separate rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import ppm
from corpusq.llm import text as T
from corpusq.llm.common import fold, prepare, rows_of

PER_LANG = 500
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def sample(documents: DataFrame, per_lang: int = PER_LANG, folds: int = 5, held: int = 0) -> DataFrame:
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held))
    # One number a language.
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / k))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select(F.col("lang").alias("label"), "text")


def fit(documents: DataFrame, per_lang: int = PER_LANG, **options) -> dict[str, ppm.Tree]:
    """A tree a language; the sample bounds what comes to the driver."""
    prepare(documents.sparkSession)
    counts = sample(documents, per_lang, **options).mapInArrow(ppm.by_label, "label string, code bigint, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n"))
    return ppm.trees(counts)


def _predict(sent) -> callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labels, models = list(sent.value), [ppm.Tree(**x) for x in sent.value.values()]
        for batch in batches:
            column = batch.column("text")
            pred, score = [], []
            for a, b, buf, offsets in T.text_slices(column):
                docs = b - a
                if not labels:
                    pred += ["und"] * docs
                    score += [0.0] * docs
                    continue
                size = ppm.lengths(models, buf, offsets)
                best = size.argmin(axis=0)
                p = 1 / np.exp2(np.maximum(size.min(axis=0)[None, :] - size, -1000)).sum(axis=0)
                has = np.concatenate([[0], np.cumsum(LETTER[buf])])
                high = np.concatenate([[0], np.cumsum(buf >= 128)])
                for i in range(docs):
                    x, y = offsets[i], offsets[i + 1]
                    letters = has[y] > has[x] or (high[y] > high[x] and any(c.isalpha() for c in bytes(buf[x:y]).decode("utf-8", "replace")))
                    pred.append(labels[best[i]] if letters else "und")
                    score.append(float(p[i]) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: dict[str, ppm.Tree], *keep: Column) -> DataFrame:
    """(row, lang_pred, score) for every document; row is a struct of the kept columns."""
    spark = prepare(documents.sparkSession)
    docs = documents.select(F.struct(*(keep or (F.col("doc_id"),))).alias("row"), "text")
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast({k: vars(x) for k, x in model.items()})), rows_of(docs, "lang_pred string, score double"))


def report(documents: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    got = predict(documents, fit(documents, folds=folds, held=held))
    doc_id = F.col("row.doc_id")
    return got.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id, folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
