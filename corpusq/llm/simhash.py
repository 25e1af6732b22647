"""Near-duplicate documents by SimHash and pivot distance tables.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, 3-word shingles with repeats (a shorter
text: all its words), each hashed with XXH64 (UTF-8, seed 42); a bit is 1 if it is set in over half the hashes.
Fingerprints link at ``bits`` or fewer differing bits; classes are the connected components.

Search: equal fingerprints are one node.  The 64 bits are cut into ``BLOCKS`` parts; two fingerprints within 3 bits
agree in at least 3 of 6 parts, so they meet in one of the 20 buckets keyed by 3 parts (about 32 bits): no pair is
lost, and buckets stay small at any number of documents.  A bucket of more than ``hot`` nodes is dealt out in
triangular cells, each pair of salts meeting in one cell.  In a bucket, distances to ``pivots`` reference fingerprints
are tabulated; nodes are ordered by the first coordinate and only neighbours within ``bits`` in it are looked at; a
pair whose largest coordinate difference exceeds ``bits`` is discarded (triangle inequality), and survivors are
verified by the Hamming distance.  A bucket emits a star per local class, never all its pairs.

Defined cases: null, empty or blank text has fingerprint zero and links like any other; rows of equal doc_id are
separate documents; a null doc_id is no class id unless the class has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm import text as T
from corpusq.llm.common import columns, cut, prepare, rows_of
from corpusq.llm.components import roots

BITS, BLOCKS, PIVOTS, HOT = 3, 6, 16, 1024
SHINGLE = 3


def fingerprint_slice(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each document of a slice."""
    starts, ends, cum = T.spans(buf, offsets, T.NONSPACE)
    spaced, starts, ends = T.single_spaced(buf, starts, ends)
    n = np.diff(cum)
    docs = len(n)
    per = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(docs), per)
    begin = np.arange(len(doc)) - first[doc] + cum[doc]
    last = begin + np.minimum(n[doc], shingle) - 1
    h = T.xxh64(spaced, starts[begin], ends[last] - starts[begin], 42)
    return majority(h, per)


_LANES = np.zeros(256, np.uint64)
for _b in range(8):
    _LANES += ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes, of sizes ``per``, the bits set in over half of them."""
    out = np.zeros(len(per), np.uint64)
    if not len(h):
        return out
    groups = -(-per // 255)
    owner = np.repeat(np.arange(len(per)), groups)
    first = np.cumsum(per) - per
    at = first[owner] + 255 * (np.arange(len(owner)) - (np.cumsum(groups) - groups)[owner])
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    full = per[owner[starts]].astype(np.int64)
    for b in range(8):
        lanes = _LANES[((h >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
        sums = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(sums, starts, axis=0)
        for j in range(8):
            out[owner[starts]] |= ((2 * sums[:, j]) > full).astype(np.uint64) << np.uint64(8 * b + j)
    return out


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [fingerprint_slice(buf, offsets) for _, _, buf, offsets in T.text_slices(batch.column("text"))]
        fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fp.view(np.int64))], ["row", "fp"])


def fingerprints(documents: DataFrame, *keep: Column) -> DataFrame:
    """(row, fp) for every document: row is a struct of the kept columns, fp the fingerprint as a signed 64-bit integer."""
    prepare(documents.sparkSession)
    docs = documents.select(F.struct(*keep).alias("row"), F.col("text"))
    return docs.mapInArrow(_fingerprints, rows_of(docs, "fp bigint"))


def masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Bit masks of the buckets' keys: every choice of blocks - bits of the parts."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fp: np.ndarray, pivots: int) -> np.ndarray:
    """The pivot table: Hamming distance of each fingerprint to each reference fingerprint."""
    refs = T.splitmix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component of the links (u, v)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def links(group: np.ndarray, fp: np.ndarray, bits: int = BITS, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what is linked within each group of fingerprints."""
    table = distances(fp, pivots)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    live = np.arange(len(fp) - 1)
    us, vs, held, k = [], [], 0, 1
    while len(live):
        live = live[: np.searchsorted(live, len(fp) - k)]
        live = live[(group[live] == group[live + k]) & (table[live + k, 0] - table[live, 0] <= bits)]
        pair = live
        for j in range(1, pivots):
            pair = pair[np.abs(table[pair, j] - table[pair + k, j]) <= bits]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + k]) <= bits]
        us.append(fp[pair])
        vs.append(fp[pair + k])
        held += len(pair)
        if held > 1 << 20:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
        k += 1
    if not us:
        return fp[:0], fp[:0]
    return stars(np.concatenate(us), np.concatenate(vs))


def _buckets(bits: int, pivots: int, rows: int = 1 << 18) -> callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("t", "key", "a", "b")
        held: list[np.ndarray] = []

        def flush(last: bool) -> Iterator:
            x = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            held.clear()
            if len(x):
                new = np.concatenate([[True], np.any(x[1:, :4] != x[:-1, :4], axis=1)])
                upto = len(x) if last else int(np.flatnonzero(new)[-1])
                if upto < len(x):
                    held.append(x[upto:])
                group = np.cumsum(new)[:upto]
                u, v = links(group, x[:upto, 4].astype(np.uint64), bits, pivots) if upto else (x[:0, 4], x[:0, 4])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*names, "fp")], axis=1))
            if sum(map(len, held)) >= rows:
                yield from flush(False)
        yield from flush(True)

    return run


def edges(nodes: DataFrame, bits: int = BITS, pivots: int = PIVOTS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect all that is linked."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(BLOCKS, bits))]))
    rows = nodes.select("fp", keys.alias("k")).select("k.t", "k.key", "fp")
    salts = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "key", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    salts = cut(salts)
    rows = rows.withColumn("salts", F.lit(None).cast("int")) if salts.isEmpty() else rows.join(salts, ["t", "key"], "left")
    s = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    cells = F.when(F.col("salts").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda o: F.struct(F.least(o, s).alias("a"), F.greatest(o, s).alias("b")))
    )
    rows = rows.select("t", "key", "fp", F.explode(cells).alias("c")).select("t", "key", "c.a", "c.b", "fp")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    return dealt.mapInArrow(_buckets(bits, pivots), "u bigint, v bigint")


def classes(documents: DataFrame, *keep: Column, bits: int = BITS, pivots: int = PIVOTS, hot: int = HOT, root: bool = False) -> DataFrame:
    """(row, fp, component_id) for every document; component_id is the smallest doc_id that is reachable over links.

    With ``root`` also the class's smallest fingerprint, which names classes without any doc_id, too.
    """
    kept = keep or (F.col("doc_id"),)
    docs = cut(fingerprints(documents, *kept))
    nodes = cut(docs.groupBy("fp").agg(F.min("row.doc_id").alias("least")))
    found = cut(roots(edges(nodes.select("fp"), bits, pivots, hot)))
    member = found.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    own = [F.coalesce("root", "fp").alias("root")] if root else []
    linked = member.join(least, "root").select("fp", "component_id", *(["root"] if root else []))
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), *own)
    # From the checkpoint, both sides of the join are plain exchanges, so that a hot fingerprint can be split.
    return docs.join(cut(named), "fp")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def identity(text: Column) -> Column:
    """128 bits of a text; null is unlike any text."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.unhex(F.lit("00")))


def one_each(documents: DataFrame, identity_of: Callable[[Column], Column] = identity, **options) -> DataFrame:
    """One document of each class, the one of smallest doc_id, with all columns.

    Of rows of that doc_id with different texts, the one of smallest ``identity``; of repeated rows, one; of a class without
    any doc_id, one as well.  Texts are told apart by doc_id and ``identity`` together: at 128 bits, two texts of one doc_id
    that share it are not to be expected in any corpus (under 1e-18 at 2e10 rows of one doc_id).
    """
    h = identity_of(F.col("text"))
    found = classes(documents, F.col("doc_id"), h.alias("h"), root=True, **options)
    first = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("row.h").alias("h"))
    stay = found.groupBy("root").agg(F.min(first).alias("s")).select(F.col("s.doc_id").alias("__doc_id"), F.col("s.h").alias("__h")).distinct()
    rows = documents.select(F.struct(*columns(documents)).alias("doc"), F.col("doc_id").alias("__id"), h.alias("__own"))
    rows = rows.join(stay, F.col("__id").eqNullSafe(F.col("__doc_id")) & (F.col("__own") == F.col("__h")))
    n = F.row_number().over(Window.partitionBy("__id", "__own").orderBy(F.lit(0)))
    return rows.select("doc", n.alias("n")).where("n = 1").select("doc.*")


def brute(documents: list[tuple], bits: int = BITS) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs, for tests."""
    import re

    import xxhash

    fps = []
    for _, t in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least: dict[int, int] = {}
    for (d, _), c in zip(documents, label):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return [(d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(documents, fps, label)]
