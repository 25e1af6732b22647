"""Words in runs of ideographs: a lexicon learned from the corpus by aggregation, and best paths over it.

No dictionary comes with the engine, so one is learned: an n-gram of ideographs is a word if it is frequent and cohesive,
that is, if it occurs so many times oftener than its parts would beside each other by chance, however it is split in two.
Counting is an aggregation over all texts that combines before its shuffle; cohesion joins a word's parts with their
counts.  Costs are whole numbers, floor(1000 ln(total / n)), so that equal paths are equal everywhere.

A run is cut into the words of least total cost, the longer first word winning ties.  ``search`` adds, before a word of
three characters or more, the words of two and three within it, so that queries for parts find it.  Index and query are cut
by the same ``Segmenter``; it stands wherever a style of ``functions.text.tokens`` does.

The lexicon that is sent to the tasks has at most ``SIZE`` words, the most frequent ones, which bounds the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import LIBRARY_STOP_WORDS, STOP_WORDS

#: Longest word; least count; least cohesion; most words.
MOST, LEAST, COHESION, SIZE = 4, 5, 20.0, 1 << 16
SCHEMA = "word string, n bigint, cost int"
#: Ideographs of a run that are counted at once.
PIECE = 1024
#: Texts that a task cuts before their words are packed.
ROWS = 64


def ngrams(texts: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """(word, n): how often each run of 1 to ``most`` ideographs occurs."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(r"(\p{IsHan}+)"), F.lit(1))).alias("run"))
    chars = runs.select(F.regexp_extract_all("run", F.lit(r"(\p{IsHan})"), F.lit(1)).alias("run"))
    # A piece holds the n-grams that begin in it, so it reaches most - 1 ideographs into the next one.
    at = F.explode(F.sequence(F.lit(1), F.size("run"), F.lit(PIECE)))
    pieces = chars.select("run", at.alias("at")).select(F.slice("run", F.col("at"), PIECE + most - 1).alias("c"), F.least(F.lit(PIECE), F.size("run") - F.col("at") + 1).alias("own"))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.least(F.col("own"), F.size("c") - k + 1)), lambda i: F.array_join(F.slice(F.col("c"), i, k), ""))
    words = [F.when(F.least(F.col("own"), F.size("c") - k + 1) >= 1, grams(k)).otherwise(F.array().cast("array<string>")) for k in range(1, most + 1)]
    return pieces.select(F.explode(F.concat(*words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lexicon(counts: DataFrame, least: int = LEAST, cohesion: float = COHESION, size: int = SIZE) -> DataFrame:
    """(word, n, cost) of single ideographs and of cohesive n-grams(word, n) that occur ``least`` times; the ``size`` most frequent.

    counts should be written before, as they are read several times.
    """
    often = counts.where(F.col("n") >= least)
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
    split = often.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    split = split.select("word", "n", F.substring(F.col("word"), F.lit(1), F.col("k")).alias("a"), F.substring(F.col("word"), F.col("k") + 1, F.length("word")).alias("b"))
    for side in ("a", "b"):
        split = split.join(often.select(F.col("word").alias(side), F.col("n").alias(f"n{side}")), side)
    ratio = F.col("n").cast("double") * F.col("chars") / F.col("na") / F.col("nb")
    bound = split.crossJoin(F.broadcast(total)).groupBy("word", "n").agg(F.min(ratio).alias("ratio")).where(F.col("ratio") >= cohesion).select("word", "n")
    words = often.where(F.length("word") == 1).unionByName(bound).orderBy(F.col("n").desc(), "word").limit(size)
    whole = words.agg(F.sum("n").cast("double").alias("whole"))
    return words.crossJoin(F.broadcast(whole)).select("word", "n", F.floor(1000 * F.log(F.col("whole") / F.col("n"))).cast("int").alias("cost"))


def best_path(run: str, costs: dict[str, int], most: int) -> list[str]:
    """Words of least total cost; an unknown ideograph costs more than any word; of equal paths, the longer first word."""
    unknown = max(costs.values(), default=0) + 1000
    best, step = [0] * (len(run) + 1), [0] * len(run)
    for i in range(len(run) - 1, -1, -1):
        best[i], step[i] = unknown + best[i + 1], 1
        for k in range(1, min(most, len(run) - i) + 1):
            c = costs.get(run[i : i + k])
            if c is not None and c + best[i + k] <= best[i]:
                best[i], step[i] = c + best[i + k], k
    out, i = [], 0
    while i < len(run):
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


@dataclass(frozen=True)
class Segmenter:
    """A tokenizer over a lexicon: a style for ``functions.text.tokens``, ``postings.build`` and whatever takes one."""

    sent: Broadcast
    most: int = MOST
    search: bool = True
    stop: tuple[str, ...] = tuple(STOP_WORDS)

    @classmethod
    def of(cls, words: DataFrame, search: bool = True, library: bool = False) -> Segmenter:
        """words are rows of ``lexicon``, at most ``SIZE``; they are sent to all tasks."""
        costs = {r.word: r.cost for r in words.limit(SIZE + 1).collect()}
        if len(costs) > SIZE:
            raise ValueError(f"a lexicon has at most {SIZE} words")
        most = max(map(len, costs), default=1)
        return cls(words.sparkSession.sparkContext.broadcast(costs), most, search, tuple(LIBRARY_STOP_WORDS if library else STOP_WORDS))

    def cut(self, run: str) -> list[str]:
        """The words of a run of ideographs, with those within them if ``search``."""
        costs, out = self.sent.value, []
        for word in best_path(run, costs, self.most):
            for k in (2, 3) if self.search else ():
                if len(word) > k:
                    out += [p for p in (word[i : i + k] for i in range(len(word) - k + 1)) if p in costs]
            out.append(word)
        return out

    def terms(self, text: str | None) -> list[str]:
        """Tokens in order: words of ideographs, and runs of other letters and digits, which are never cut; without single
        ASCII letters or digits and stop words."""
        import regex

        out: list[str] = []
        for m in regex.finditer(r"(\p{Han}+)|((?:(?!\p{Han})[\p{L}\p{N}_])+)", (text or "").lower()):
            out += self.cut(m[1]) if m[1] else [m[2]]
        stop = frozenset(self.stop)
        return [t for t in out if not (len(t) == 1 and t.isascii() and t.isalnum()) and t not in stop]

    def tokens(self, text: Column) -> Column:
        """``terms`` as a column, over Arrow batches, of which ``ROWS`` texts at a time are Python objects."""

        @F.arrow_udf("array<string>")
        def run(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.string())
            parts = (pa.array([self.terms(x) for x in texts.slice(i, ROWS).to_pylist()], kind) for i in range(0, len(texts), ROWS))
            return pa.concat_arrays([pa.array([], kind), *parts])

        return run(text)
