"""Token counts by sections with offset-mapped attribution.

Whole texts are encoded once with a byte-level BPE vocabulary.  Such an encoding loses nothing, so the running sum of
the tokens' byte lengths gives every token's span, in bytes and, over the bytes that begin a code point, in
characters.  Spans are interval-joined to sections (spans of characters; by default the lines, each with its line
end), and a token that crosses a boundary is allocated by a rule: ``first`` (the section of its first byte), ``last``
(of its last), ``most`` (that with most of its bytes, the first of equals) or ``split`` (to each by its share of
bytes).  A byte of a split code point belongs where the code point does.

The vocabulary's path is a parameter; the file (under 1 MB) is read by the driver and broadcast.

Defined cases: a null or empty text has no tokens and no sections; tokens outside all given sections are counted in
n_tokens only; given sections must be sorted and separate; repeated documents are separate rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm import text as T
from corpusq.llm.common import prepare, rows_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that byte-level vocabularies of this kind are used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most", "split")


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int]):
    """A function from text to the byte lengths of its tokens."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return lambda text: size[own.encode_to_numpy(text).astype(np.int64)] if text else size[:0]


def allocate(ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [first, last) in bytes, and how many tokens lie in more than one or partly outside.

    ends: byte place after each token; the first token begins at 0.
    """
    out = np.zeros(len(first))
    if not len(first) or not len(ends):
        return out, 0
    begins = np.concatenate([[0], ends[:-1]])
    a = np.searchsorted(last, begins, "right")
    b = np.searchsorted(first, ends, "left") - 1
    whole = (a == b) & (first[np.minimum(a, len(first) - 1)] <= begins) & (last[np.minimum(a, len(first) - 1)] >= ends)
    out += np.bincount(a[whole], minlength=len(first))
    rest = np.flatnonzero(~whole)
    for t in rest:
        inside = {s: min(ends[t], last[s]) - max(begins[t], first[s]) for s in range(a[t], b[t] + 1)}
        if rule == "split":
            for s, n in inside.items():
                out[s] += n / (ends[t] - begins[t])
        elif rule == "most":
            if inside:
                out[max(inside, key=lambda s: (inside[s], -s))] += 1
        else:
            at = begins[t] if rule == "first" else ends[t] - 1
            for s in inside:
                if first[s] <= at < last[s]:
                    out[s] += 1
    return out, len(rest)


def _count(sent, rule: str, lines: bool) -> callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lengths = encoder(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            given = None if lines else batch.column("sections").to_pylist()
            n, crossing, tokens = [], [], []
            for i, text in enumerate(texts):
                text = text or ""
                ends = np.cumsum(lengths(text))
                raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                if lines:
                    cuts = np.flatnonzero(raw == 10) + 1
                    cuts = cuts[cuts < len(raw)]
                    first = np.concatenate([[0], cuts]) if len(raw) else np.zeros(0, np.int64)
                    last = np.append(cuts, len(raw)) if len(raw) else first
                else:
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    first = at[[min(s["first"], len(at) - 1) for s in given[i] or []]] if given[i] else np.zeros(0, np.int64)
                    last = at[[min(s["last"], len(at) - 1) for s in given[i] or []]] if given[i] else first
                got, k = allocate(ends, first, last, rule)
                n.append(len(ends))
                crossing.append(k)
                tokens.append(got)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(tokens, pa.list_(pa.float64()))], ["row", "n_tokens", "n_crossing", "tokens"])

    return run


def attribute(documents: DataFrame, *keep: Column, sections: Column | None = None, rule: str = "first", path: str = VOCABULARY) -> DataFrame:
    """(row, n_tokens, n_crossing, tokens) for every document; tokens has a number for each section, in order.

    sections: array<struct<first, last>> of character places, last exclusive; without it, lines are the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = prepare(documents.sparkSession)
    columns = [F.struct(*(keep or (F.col("doc_id"),))).alias("row"), F.col("text")]
    docs = documents.select(*columns) if sections is None else documents.select(*columns, sections.alias("sections"))
    sent = spark.sparkContext.broadcast(vocabulary(path))
    return docs.mapInArrow(_count(sent, rule, sections is None), rows_of(docs, "n_tokens bigint, n_crossing bigint, tokens array<double>"))


def report(documents: DataFrame, rule: str = "first", path: str = VOCABULARY) -> DataFrame:
    """Tokens of every document by line."""
    got = attribute(documents, rule=rule, path=path)
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", F.size("tokens").cast("bigint").alias("n_sections"), "n_crossing", F.transform("tokens", lambda x: x.cast("bigint")).alias("section_tokens"))
