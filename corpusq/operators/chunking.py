"""Markdown chunks: sections by heading, sentence packing of long ones, and merging of short ones.

A document's chunks depend on running token sums, so each document is one fold in Python; documents are independent
and stream through Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]|$)")
UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
ENDS = re.compile(r"[。！？!?]|\.(?!\d)")


@dataclass(frozen=True)
class Chunk:
    content: str
    tokens: int
    first: int
    last: int


def estimate(text: str) -> int:
    """Tokens by length: a quarter of the characters, rounded up."""
    return math.ceil(len(text) / 4)


def heading_lines(lines: list[str]) -> list[int]:
    """Places of headings as CommonMark sees them: ATX or underlined, not within fences."""
    found, fence = [], None
    for i, line in enumerate(lines):
        mark = FENCE.match(line)
        if fence:
            fence = None if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(mark[1][0]) else fence
        elif mark:
            fence = mark[1]
        elif ATX.match(line):
            found.append(i)
        elif i and UNDERLINE.match(line) and lines[i - 1].strip() and not ATX.match(lines[i - 1]) and (i - 1) not in found and not lines[i - 1].lstrip().startswith((">", "- ", "* ", "|")):
            start = i - 1
            while start and lines[start - 1].strip() and start - 1 not in found and not ATX.match(lines[start - 1]) and not FENCE.match(lines[start - 1]):
                start -= 1
            found.append(start)
    return found


def sections(markdown: str) -> list[tuple[str, int, int]]:
    """(text, first, last) between headings, lines from 1; blank sections are left out unless there is no heading at all."""
    lines = markdown.split("\n")
    heads = heading_lines(lines)
    if not heads:
        return [(markdown, 1, len(lines))]
    edges = [0, *heads, len(lines)] if heads[0] else [*heads, len(lines)]
    spans = zip(edges, edges[1:])
    return [("\n".join(lines[a:b]), a + 1, b) for a, b in spans if "".join(lines[a:b]).strip()]


def sentences(text: str) -> list[str]:
    at, out = 0, []
    for m in ENDS.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    return [s for s in (*out, text[at:].strip()) if s]


def fragments(text: str, most: int, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """Pieces of at most ``most`` characters, made shorter by a fifth until they have at most ``most`` tokens."""
    while text:
        size = min(len(text), most)
        while (n := count(text[:size])) > most and size > 1:
            size = max(1, int(size * 0.8))
        yield text[:size], n
        text = text[size:]


def pack(text: str, most: int, overlap: float, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """Sentences in order, filled up to ``most`` tokens; a full piece's last sentences are repeated in the next one."""
    held: list[tuple[str, int]] = []

    def piece() -> Iterator[tuple[str, int]]:
        joined, total = " ".join(s for s, _ in held), sum(n for _, n in held)
        # The sum may be over the limit where an overlap was kept.
        yield from [(joined, total)] if total <= most else fragments(joined, most, count)

    for sentence in sentences(text):
        n = count(sentence)
        if n > most:
            if held:
                yield from piece()
            held = []
            yield from fragments(sentence, most, count)
            continue
        if held and sum(k for _, k in held) + n > most:
            yield from piece()
            keep = math.ceil(len(held) * overlap)
            held = held[len(held) - keep :] if keep else []
        held.append((sentence, n))
    if held:
        yield from piece()


def chunk(markdown: str, least: int = 400, most: int = 800, overlap: float = 0.1, count: Callable[[str], int] = estimate) -> list[Chunk]:
    """A short chunk takes up the next one while both together have at most ``most`` tokens.

    Pieces of a long section have the whole section's lines.
    """
    parts = []
    for text, first, last in sections(markdown):
        n = count(text)
        parts += [Chunk(text, n, first, last)] if n <= most else [Chunk(t, k, first, last) for t, k in pack(text, most, overlap, count)]
    out: list[Chunk] = []
    for part in parts:
        if out and out[-1].tokens < least and out[-1].tokens + part.tokens <= most:
            before = out.pop()
            part = replace(part, content=f"{before.content}\n\n{part.content}", tokens=before.tokens + part.tokens, first=before.first)
        out.append(part)
    return out


#: Files of a batch that are cut before their chunks leave the task.
ROWS = 64
SCHEMA = "file_id string, idx int, chunk_id string, content string, tokens int, line_start int, line_end int, locator string"


def chunk_files(files: DataFrame, least: int = 400, most: int = 800, overlap: float = 0.1, padded: bool = True, count: Callable[[str], int] = estimate) -> DataFrame:
    """files(file_id, content) to chunks; a task holds those of ``ROWS`` files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(chunk(text or "", least, most, overlap, count)):
                    number = f"{i:04d}" if padded else str(i)
                    rows.append({"file_id": key, "idx": i, "chunk_id": f"{key}:{number}", "content": c.content, "tokens": c.tokens, "line_start": c.first, "line_end": c.last, "locator": f"line:{c.first}-{c.last}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.string()), ("idx", pa.int32()), ("chunk_id", pa.string()), ("content", pa.string()), ("tokens", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("locator", pa.string())]))

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, SCHEMA)
