"""Benchmark decontamination by winnowing.

Documents and benchmark items are lower-cased (A-Z) and split into alphanumeric words.  A window is ``window``
consecutive item words; an item with fewer words, but not none, is one window.  Winnowing keeps, of every window,
the smallest hash of its ``gram``-word grams, so a span of ``window`` words that a document shares with an item has
a kept gram on both sides.  A document's kept grams are looked up among the items' kept grams; around every hit the
document's windows are looked up among the items' windows and compared with them word by word (64-bit word hashes).

The items are a query set: they are read in blocks of about ``block_chars`` characters (a partition of the benchmark
comes to the driver at a time).  Each block is broadcast by itself, the documents are matched with it in a pass that
moves no text between executors, and it is gone before the next one is sent.  With one block (any benchmark of up to
``block_chars`` characters) nothing is shuffled at all.

Defined cases: a null or empty text has no words and no hits; items without words match nothing; an item of null
item_id marks words but is not listed; rows that repeat an item_id are one item; repeated documents are separate
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import text as T
from corpusq.llm.common import cut, prepare, rows_of

WINDOW, GRAM, BLOCK_CHARS = 13, 5, 1 << 24
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Block:
    """Lookup tables for some items: kept grams, distinct windows, and the items of each window."""

    def __init__(self, names: list[str | None], texts: list[str], window: int, gram: int):
        import pyarrow as pa

        self.window, self.gram, self.names = window, gram, names
        buf, offsets = T.text_buffer(pa.array(texts, pa.large_string()))
        starts, ends, cum = T.spans(buf, offsets, T.ALNUM)
        self.words = T.hash_spans(buf, starts, ends)
        sizes = np.diff(cum)
        kept = [np.zeros(0, np.uint64)]
        if np.any(sizes >= window):
            inside, g = kept_grams(self.words, cum, window, gram)
            kept.append(g[inside])
        self.kept = np.unique(np.concatenate(kept))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        item = np.repeat(np.arange(len(names)), sizes)
        for m in np.unique(np.minimum(sizes[sizes > 0], window)):
            m = int(m)
            if m == window:
                at = np.flatnonzero(item[: len(item) - m + 1] == item[m - 1 :])
            else:
                at = cum[:-1][sizes == m]
            h = T.grams(self.words, m)[at]
            order = np.lexsort((item[at], h))
            at, h = at[order], h[order]
            keys, first = np.unique(h, return_index=True)
            self.tables[m] = (keys, at[first], np.append(first, len(h)), item[at])


def kept_grams(words: np.ndarray, cum: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that are smallest in some window within one text, and all gram hashes."""
    g = T.grams(words, gram)
    w = window - gram + 1
    if len(words) < window:
        return np.zeros(0, np.int64), g
    doc = np.repeat(np.arange(len(cum) - 1, dtype=np.int32), np.diff(cum))
    least = T.sliding(g, w, np.minimum)
    least[doc[: len(least)] != doc[window - 1 :]] = 0
    edge = np.zeros(w - 1, np.uint64)
    most = T.sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero((most == g) & (most > 0)), g


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def sieve(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def hits(block: Block, sieves: dict, words: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document windows that are item windows: their first word, their length and their row in the block's table."""
    doc = np.repeat(np.arange(len(cum) - 1, dtype=np.int32), np.diff(cum))
    found = []
    for m, (keys, at, _, _) in block.tables.items():
        if len(words) < m:
            continue
        if m == block.window:
            places, g = kept_grams(words, cum, m, block.gram)
            places = places[sieves[0][(g[places] & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            places = places[find(block.kept, g[places]) >= 0]
            near = (places[:, None] - np.arange(m - block.gram + 1)[None, :]).ravel()
            near = np.unique(near[(near >= 0) & (near <= len(words) - m)])
            if not len(near):
                continue
            c = T.constants(m, 101)
            with np.errstate(over="ignore"):
                h = words[near] * c[0]
                for j in range(1, m):
                    h += words[near + j] * c[j]
            h = T.splitmix(h)
        else:
            h = T.grams(words, m)
            near = np.flatnonzero(sieves[m][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            h = h[near]
        near, h = (lambda ok: (near[ok], h[ok]))(doc[near] == doc[near + m - 1])
        row = find(keys, h)
        near, row = near[row >= 0], row[row >= 0]
        for j in range(m):
            same = words[near + j] == block.words[at[row] + j]
            near, row = near[same], row[same]
        found.append((near, np.full(len(near), m), row))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _match(blocks: list) -> callable:
    """For mapInArrow: (keys..., text) to (keys..., n_words, spans, items)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # Plain values are broadcast; executors need not have this package.
        block = Block.__new__(Block)
        block.__dict__.update(blocks[0].value)
        sieves = {m: sieve(t[0]) for m, t in block.tables.items() if m < block.window} | {0: sieve(block.kept)}
        for batch in batches:
            n_words, spans, items = [], [], []
            for a, b, buf, offsets in T.text_slices(batch.column("text")):
                starts, ends, cum = T.spans(buf, offsets, T.ALNUM)
                words = T.hash_spans(buf, starts, ends)
                first, size, row = hits(block, sieves, words, cum)
                n_words.append(np.diff(cum))
                doc = np.searchsorted(cum, first, "right") - 1
                mine: dict[int, list[int]] = {}
                for d in np.unique(doc):
                    mine[int(d)] = np.flatnonzero(doc == d)
                for d in range(b - a):
                    if d not in mine:
                        spans.append([])
                        items.append([])
                        continue
                    k = mine[d]
                    begin, end = merged(first[k] - cum[d], first[k] - cum[d] + size[k])
                    spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(begin, end)])
                    got: set[int] = set()
                    for m in np.unique(size[k]):
                        _, _, cuts, owners = block.tables[int(m)]
                        for r in np.unique(row[k][size[k] == m]):
                            got.update(owners[cuts[r] : cuts[r + 1]].tolist())
                    items.append(sorted({x for x in (block.names[i] for i in got) if x is not None}))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            out = [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *out], [*batch.schema.names[:-1], "n_words", "spans", "items"])

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as intervals that don't touch."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def blocks_of(benchmark: DataFrame, window: int, gram: int, block_chars: int) -> Iterator[Block]:
    """The items in blocks; only one partition of the benchmark is held on the driver at a time."""
    names: list[str | None] = []
    texts: list[str] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        names.append(r.i)
        texts.append(r.t)
        held += len(r.t)
        if held >= block_chars:
            yield Block(names, texts, window, gram)
            names, texts, held = [], [], 0
    if texts:
        yield Block(names, texts, window, gram)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: row (struct of the kept columns), n_words, spans (hit words as inclusive ranges) and items (ids as strings, sorted)."""
    spark = prepare(documents.sparkSession)
    kept = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("row")
    found_schema = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"
    blocks = blocks_of(benchmark, window, gram, block_chars)
    block, after = next(blocks, Block([], [], window, gram)), next(blocks, None)
    sent = spark.sparkContext.broadcast(vars(block))
    if after is None:
        docs = documents.select(kept, "text")
        return docs.mapInArrow(_match([sent]), rows_of(docs, found_schema))
    # More than one block: what a block hits depends on the text alone, so hits are kept by the text's 128-bit hash, a
    # table a block; one block is live at a time, and texts are neither shuffled nor written.
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")]
    texts = documents.select(*key, "text").where("text is not null")
    found = None
    while block is not None:
        rows = texts.mapInArrow(_match([sent]), f"k1 bigint, k2 bigint, {found_schema}").where(F.size("spans") > 0)
        part = cut(rows.groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        found = part if found is None else found.unionByName(part)
        sent.destroy()
        block, after = after, next(blocks, None)
        sent = spark.sparkContext.broadcast(vars(block)) if block else None
    rows = found.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = "aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (a, x) -> case when size(a) > 0 and x.first <= element_at(a, -1).last + 1 then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))) else concat(a, array(x)) end)"
    docs = documents.select(kept, *key, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    none = {"spans": F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), "items": F.expr("cast(array() as array<string>)")}
    joined = docs.join(rows.withColumn("spans", F.expr(step)), ["k1", "k2"], "left")
    return joined.select("row", "n_words", *[F.coalesce(c, x).alias(c) for c, x in none.items()])


def report(documents: DataFrame, benchmark: DataFrame, part: int = 20, **options) -> DataFrame:
    """``matches`` with counts: a document is contaminated if at least one word in ``part`` is hit."""
    found = matches(documents, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumns({
        "n_hit": n_hit,
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, part: int = 20, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    return report(documents, benchmark, part, keep=tuple(documents.columns), **options).where(~F.col("contaminated")).select("row.*")


def brute(documents: list[tuple], items: list[tuple], window: int = WINDOW, part: int = 20) -> list[tuple]:
    """The same by plain search, for tests: rows of ``report`` without spans."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for i, t in documents:
        w, hit, got = words(t), set(), set()
        for name, x in items:
            v = words(x)
            m = min(window, len(v))
            wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    if name is not None:
                        got.add(str(name))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and part * len(hit) >= len(w)))
    return out
