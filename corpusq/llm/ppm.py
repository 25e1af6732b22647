"""Prediction by partial matching over bytes: context trees of order up to 3, frozen and tabulated.

Every byte of a text, and a final end symbol (byte 0), is predicted from the three bytes before it (0 before the
start).  The probability is looked for in the longest context that the tree holds: a symbol seen n times among N with
d distinct ones has n / (N + d); the escape, d / (N + d), goes to the next shorter context, where the symbols seen in
longer ones are excluded; at last the symbols never seen share what is left evenly.  With frozen counts the result
depends on the deepest context and the symbol only, so it is tabulated once: scoring is two gathers a byte.

The tree holds the most frequent contexts of each order, as many as the given bounds allow; a context outside it
falls back to the next shorter one.  Counts are taken over all training texts, whatever the tree's size.  With
``order2`` at ``ALL2`` the tree has every order-2 context there can be, and ``beyond`` gives the exact cost of symbols
in the order-3 contexts outside it, from a table of their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import text as T
from corpusq.llm.common import cut

ORDER3, ORDER2 = 24000, 8000
ALL2 = 1 << 16


@dataclass
class Model:
    labels: list
    two: np.ndarray  # order-2 contexts, as 16-bit codes
    three: np.ndarray  # order-3 contexts, as 24-bit codes
    cost: np.ndarray  # bits, (labels, nodes * 256); nodes: root, 256 of order 1, two, three
    seen: np.ndarray | None = None  # counts of the last label in the nodes of orders 0 to 2, if they are asked for

    def states(self) -> np.ndarray:
        """Deepest node of every three bytes."""
        kind = np.uint16 if 257 + len(self.two) + len(self.three) <= 1 << 16 else np.uint32
        out = np.empty((256, 65536), kind)
        out[:] = np.tile(np.arange(1, 257, dtype=kind), 256)[None, :]
        out[:, self.two] = np.arange(257, 257 + len(self.two), dtype=kind)[None, :]
        out = out.reshape(-1)
        out[self.three] = np.arange(257 + len(self.two), 257 + len(self.two) + len(self.three), dtype=kind)
        return out


def codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the three bytes before it, as 32 bits, and the documents' cuts in that sequence."""
    docs = len(offsets) - 1
    sizes = np.diff(offsets)
    padded = np.zeros(len(buf) + 4 * docs, np.uint32)
    begin = offsets[:-1] + 4 * np.arange(docs)
    skip = np.ones(len(padded), bool)
    for j in range(3):
        skip[begin + j] = False
    inside = skip.copy()
    inside[begin + 3 + sizes] = False
    padded[inside] = buf
    code = padded.copy()
    for j in (1, 2, 3):
        code[j:] |= padded[:-j] << np.uint32(8 * j)
    return code[skip], offsets + np.arange(docs + 1)


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def add(held: dict, key, values: np.ndarray, most: int = 1 << 21) -> None:
    """Counts of values, kept under key; they are merged when there are more than ``most``."""
    parts = held.setdefault(key, [])
    parts.append(np.unique(values, return_counts=True))
    if sum(len(k) for k, _ in parts[1:]) > max(most, len(parts[0][0])):
        parts[:] = [tally(parts)]


def by_label(batches: Iterator) -> Iterator:
    """(label, text) to (label, code, n)."""
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for a, b, buf, offsets in T.text_slices(batch.column("text")):
            code, cuts = codes(buf, offsets)
            for label in set(labels[a:b]):
                mine = [code[cuts[i] : cuts[i + 1]] for i in range(b - a) if labels[a + i] == label]
                add(held, label, np.concatenate(mine))
    for label, parts in held.items():
        k, n = tally(parts)
        for i in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(k[i : i + (1 << 16)]), pa.string()), pa.array(k[i : i + (1 << 16)].astype(np.int64)), pa.array(n[i : i + (1 << 16)])], ["label", "code", "n"])


def frequent(totals: DataFrame, most: int) -> DataFrame:
    """Keys of the largest totals, ``most`` at most: a histogram of 8 steps an octave sets the least total.

    Of the step that doesn't fit as a whole, the keys of the smallest hashes fill the room that is left.
    """
    step = F.floor(8 * F.log2("total")).cast("int")
    part = F.shiftrightunsigned(F.xxhash64(*[c for c in totals.columns if c != "total"]), 48)
    # At most some 500 steps, and 65536 parts of one of them.
    steps = sorted(((r.s, r.n) for r in totals.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    have, least, upto = 0, -1, 1 << 16
    for s, n in steps:
        if have + n > most:
            least, upto = s, 0
            parts = totals.where(step == s).groupBy(part.alias("p")).agg(F.count("*").alias("n"))
            for p, k in sorted((r.p, r.n) for r in parts.collect()):
                if have + k > most:
                    break
                have, upto = have + k, p + 1
            break
        have += n
    return totals.where((step > least) | ((step == least) & (part < upto))).drop("total")


def suffix(two: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Node of the longest context of order 1 or 2 that ends each context."""
    if not len(two):
        return 1 + (context & 255)
    place = np.minimum(np.searchsorted(two, context & 65535), len(two) - 1)
    return np.where(two[place] == context & 65535, 257 + place, 1 + (context & 255))


def build(counts: DataFrame, order3: int = ORDER3, order2: int = ORDER2, keep: bool = False) -> Model:
    """The tabulated model of counts (label, code, n): one row per label and code; keep: with ``seen``."""
    code = F.col("code")
    sums = {}
    for order, width in ((1, 16), (2, 24), (3, 32)):
        rows = counts if order == 3 else counts.groupBy("label", code.bitwiseAND((1 << width) - 1).alias("code")).agg(F.sum("n").alias("n"))
        if order > 1:
            context = F.shiftright("code", 8).alias("context")
            rows = cut(rows) if order < 3 else rows
            chosen = frequent(rows.groupBy(context).agg(F.sum("n").alias("total")), order3 if order == 3 else order2)
            rows = rows.join(F.broadcast(chosen), F.shiftright(rows["code"], 8) == chosen["context"]).drop("context")
        sums[order] = rows.toArrow()
    labels = sorted(set(sums[1]["label"].to_pylist()))
    at = {x: i for i, x in enumerate(labels)}
    got = {}
    for order, t in sums.items():
        where = np.array([at[x] for x in t["label"].to_pylist()], np.int64)
        got[order] = (where, t["code"].to_numpy(), t["n"].to_numpy())
    two = np.unique(got[2][1] >> 8) if len(got[2][1]) else np.zeros(0, np.int64)
    three = np.unique(got[3][1] >> 8) if len(got[3][1]) else np.zeros(0, np.int64)
    nodes = 257 + len(two) + len(three)
    cost = np.empty((max(1, len(labels)), nodes * 256), np.float32)
    # Row of the next shorter context of every node; -1 where it isn't in the tree.
    shorter = np.zeros(nodes, np.int64)
    shorter[0] = -1
    shorter[257 : 257 + len(two)] = 1 + (two & 255)
    shorter[257 + len(two) :] = suffix(two, three)
    for i in range(max(1, len(labels))):
        seen = np.zeros((nodes, 256), np.int64)
        for order, base in ((1, None), (2, two), (3, three)):
            where, c, n = got[order]
            c, n = c[where == i], n[where == i]
            row = 1 + (c >> 8) if order == 1 else (257 if order == 2 else 257 + len(two)) + np.searchsorted(base, c >> 8)
            seen[row, c & 255] = n
        seen[0] = seen[1:257].sum(axis=0)
        for a in range(0, nodes, 2048):
            cost[i, a * 256 : (a + 2048) * 256] = bits(seen, shorter, np.arange(a, min(a + 2048, nodes))).reshape(-1)
    return Model(labels, two, three, cost, seen[: 257 + len(two)].copy() if keep else None)


def bits(seen: np.ndarray, shorter: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Code length of every symbol in the contexts ``rows``, with exclusion of what longer contexts have seen.

    own: counts of longer contexts, one each, that stand before ``rows``.
    """
    out = np.zeros((len(rows), 256))
    out_of = np.zeros((len(rows), 256), bool)
    left = np.ones(len(rows))
    at = rows.copy()
    while np.any(at >= 0):
        n = np.where((at >= 0)[:, None], seen[np.maximum(at, 0)], 0) if own is None else own
        n = np.where(out_of, 0, n).astype(np.float64)
        new = n > 0
        total, kinds = n.sum(axis=1), new.sum(axis=1)
        all_out = out_of | new
        escape = np.where(all_out.all(axis=1), 0, kinds)
        share = left / np.maximum(total + escape, 1)
        out += n * share[:, None]
        left = np.where(kinds > 0, share * escape, left)
        out_of = all_out
        if own is None:
            at = np.where(at >= 0, shorter[np.maximum(at, 0)], -1)
        own = None
    rest = 256 - out_of.sum(axis=1)
    out += ~out_of * (left / np.maximum(rest, 1))[:, None]
    return -np.log2(np.maximum(out, 1e-300))


def beyond(sent) -> callable:
    """(code, next) to (code, bits): next has the (symbol, n) seen in the code's order-3 context, null if there are none.

    sent: two and seen of a model that has all order-2 contexts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        two, seen = sent.value
        shorter = np.zeros(len(seen), np.int64)
        shorter[0] = -1
        shorter[257:] = 1 + (two & 255)
        for batch in batches:
            code, follow = batch.column("code").to_numpy(), batch.column("next")
            own = np.zeros((len(code), 256), np.int64)
            flat = follow.flatten()
            row = np.repeat(np.arange(len(code)), follow.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            own[row, flat.field("symbol").to_numpy()] = flat.field("n").to_numpy()
            cost = bits(seen, shorter, suffix(two, code >> 8), own)[np.arange(len(code)), code & 255]
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(cost)], ["code", "bits"])

    return run


@dataclass
class Tree:
    """The whole context tree of one label, as sorted tables: of every order the contexts and the symbols seen in them.

    A symbol seen in a shorter context has been seen wherever a longer one that ends in it has, so what is excluded
    there is the longer context's own set: its sum is tabulated a context, and a cost takes one look-up an order.
    """

    keys: list  # by order: context and symbol, sorted
    contexts: list  # by order, sorted
    gain: list  # bits that a symbol's count takes off its context's denominator
    whole: list  # denominator and escape of a context that is the deepest
    after: list  # the same of the next shorter context, without what this one has seen
    rest: float = 8.0  # bits of a symbol never seen, after all escapes

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray) -> Tree:
        self = cls([], [], [], [], [])
        for order in range(4):
            keys, at = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.bincount(at, n, len(keys))
            contexts, owner = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(owner, seen, len(contexts)), np.bincount(owner, minlength=len(contexts))
            self.whole.append(self.terms(total, kinds, kinds))
            if order:
                mask = (1 << 8 * order) - 1
                up = np.searchsorted(self.contexts[-1], contexts & (mask >> 8))
                out = np.bincount(owner, before[0][np.searchsorted(self.keys[-1], keys & mask)], len(contexts))
                self.after.append(self.terms(before[1][up] - out, before[2][up] - kinds, before[2][up]))
            before = (seen, total, kinds)
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.gain.append(np.log2(seen))
        self.rest = float(np.log2(max(1, 256 - len(self.keys[0]))))
        return self

    @staticmethod
    def terms(total: np.ndarray, kinds: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the denominator, and of an escape; nothing new to be seen there costs nothing."""
        escape = np.where(seen == 256, 0, kinds)
        whole = np.log2(np.maximum(total + escape, 1))
        return whole, np.where(kinds > 0, whole - np.log2(np.maximum(escape, 1e-300)), 0.0)

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Code length of every symbol after its three bytes."""
        out = np.zeros(len(code))
        live, longer = np.arange(len(code)), np.full(len(code), -1)
        for order in (3, 2, 1, 0):
            key = code[live] & ((1 << 8 * (order + 1)) - 1)
            if not len(self.keys[order]):
                continue
            at = np.minimum(np.searchsorted(self.keys[order], key), len(self.keys[order]) - 1)
            context = np.minimum(np.searchsorted(self.contexts[order], key >> 8), len(self.contexts[order]) - 1)
            hit, has = self.keys[order][at] == key, self.contexts[order][context] == key >> 8
            whole, escape = (np.where(has, x[context], 0.0) for x in self.whole[order])
            if order < 3:
                whole, escape = (np.where(longer >= 0, x[longer], y) for x, y in zip(self.after[order], (whole, escape)))
            out[live] += np.where(hit, whole - self.gain[order][at], escape)
            live, longer = live[~hit], np.where(has, context, -1)[~hit]
        out[live] += self.rest
        return out


def trees(counts: DataFrame) -> dict[str, Tree]:
    """The tree of every label, of counts (label, code, n)."""
    t = counts.toArrow()
    labels, code, n = t["label"].to_pylist(), t["code"].to_numpy(), t["n"].to_numpy()
    names = sorted(set(labels))
    at = {x: i for i, x in enumerate(names)}
    own = np.array([at[x] for x in labels], np.int64)
    return {x: Tree.of(code[own == i], n[own == i]) for i, x in enumerate(names)}


def lengths(models: list[Tree], buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length in bits of every document of a slice under every tree: (trees, documents)."""
    import pandas as pd

    code, cuts = codes(buf, offsets)
    at, distinct = pd.factorize(code)
    distinct = distinct.astype(np.int64)
    return np.stack([np.add.reduceat(m.cost(distinct)[at], cuts[:-1]) for m in models])
