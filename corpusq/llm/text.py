"""Vectorised byte-level text primitives (numpy over Arrow buffers).

All word rules of this subpackage are classes of ASCII bytes, and every byte of a multi-byte UTF-8 sequence
is >= 0x80, so words are found on bytes without decoding.  A slice of documents is handled at once; per-byte
temporaries are made in chunks of ``CHUNK`` bytes, so memory follows the number of words, not of bytes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
SLICE = 1 << 21
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags; False for the bytes of the given inclusive ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NONSPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = constants(256, 11)[LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(pow(p, k, 1 << 64))
            k += m
    return out


class _Own(dict):
    """A dictionary that every process fills for itself: it travels empty, as functions travel with all that they use."""

    def __reduce__(self):
        return (_Own, ())


_POW = _Own()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        _POW["up"], _POW["down"] = _powers(_P, CHUNK + 1), _powers(_PINV, CHUNK + 1)
    return _POW["up"], _POW["down"]


def spans(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte places in buf) of the words of each document, and the number of words before each document.

    buf holds the documents' bytes one after another; document d is ``buf[offsets[d]:offsets[d + 1]]``.
    """
    n = len(buf)
    word = kind[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[(offsets >= 0) & (offsets < n)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    last = word
    nxt = np.ones(n, bool)
    nxt[:-1] = ~word[1:] if n else nxt[:-1]
    nxt[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(last & nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-cased bytes of each span; spans are sorted and don't overlap."""
    up, down = _tables()
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    low = np.zeros(len(starts), np.uint64)
    high = np.zeros(len(starts), np.uint64)
    total = U(0)
    with np.errstate(over="ignore"):
        for base in range(0, len(buf), CHUNK):
            part = buf[base : base + CHUNK]
            k = len(part)
            run = np.empty(k + 1, np.uint64)
            run[0] = total
            scale = U(pow(_P, base, 1 << 64))
            np.cumsum(_BYTE[part] * up[:k], out=run[1:])
            run[1:] = run[1:] * scale + total
            a, b = np.searchsorted(starts, (base, base + k))
            low[a:b] = run[starts[a:b] - base]
            a, b = np.searchsorted(ends, (base + 1, base + k + 1))
            high[a:b] = run[ends[a:b] - base]
            total = run[k]
        gap = high - low
        back = down[starts % CHUNK]
        if len(buf) > CHUNK:
            block = np.array([pow(_PINV, base, 1 << 64) for base in range(0, len(buf), CHUNK)], np.uint64)
            back = back * block[starts // CHUNK]
        return splitmix(gap * back + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, k: int, seed: int = 101) -> np.ndarray:
    """Hash of each k consecutive words; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = constants(k, seed)
    with np.errstate(over="ignore"):
        out = words[:n] * c[0]
        for j in range(1, k):
            out += words[j : j + n] * c[j]
    return splitmix(out)


def sliding(values: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w consecutive values, in log2(w) passes."""
    out, have = values, 1
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = op(out[: len(out) - (w - have)], out[w - have :])
    return out


def slices(offsets: np.ndarray, most: int = SLICE):
    """(first, last) rows so that each slice has about ``most`` bytes; a longer document is a slice of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null text is empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column, most: int = SLICE):
    """(first row, last row, bytes, offsets) for slices of an Arrow string column."""
    buf, offsets = text_buffer(column)
    for a, b in slices(offsets, most):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans of buf at once."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes8 = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
    lanes4 = np.ndarray((len(pad) - 3,), "<u4", pad, 0, (1,))
    s = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + _P5, np.uint64)
        at, left = starts.astype(np.int64), lengths.astype(np.int64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            p, rest = at[long], left[long]
            live = np.arange(len(long))
            while len(live):
                for j in range(4):
                    v[j][live] = _rotl(v[j][live] + lanes8[p[live] + 8 * j] * _P2, 31) * _P1
                p[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                acc = (acc ^ (_rotl(v[j] * _P2, 31) * _P1)) * _P1 + _P4
            h[long] = acc
            at[long], left[long] = p, rest
        h += lengths.astype(np.uint64)
        live = np.flatnonzero(left >= 8)
        while len(live):
            x = h[live] ^ (_rotl(lanes8[at[live]] * _P2, 31) * _P1)
            h[live] = _rotl(x, 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        if len(live):
            x = h[live] ^ (lanes4[at[live]].astype(np.uint64) * _P1)
            h[live] = _rotl(x, 23) * _P2 + _P3
            at[live] += 4
            left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            x = h[live] ^ (pad[at[live]].astype(np.uint64) * _P5)
            h[live] = _rotl(x, 11) * _P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
    return h ^ (h >> U(32))


def single_spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the words with one space after each, and the words' new starts and ends."""
    n = len(starts)
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - (lengths + 1)
    keep = np.zeros(len(buf) + 1, bool)
    if n:
        mark = np.zeros(len(buf) + 1, np.int8)
        mark[starts] += 1
        np.add.at(mark, ends, -1)
        keep = np.cumsum(mark, dtype=np.int8).astype(bool)
    out = np.full(int(lengths.sum()) + n, 32, np.uint8)
    hole = np.ones(len(out), bool)
    hole[to + lengths] = False
    out[hole] = LOWER[buf[keep[:-1]]]
    return out, to, to + lengths
