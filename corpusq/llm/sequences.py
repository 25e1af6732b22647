"""Token ids of whole documents as Arrow stream files of equal-length sequences, and back.

``encode`` turns texts into ids with a vocabulary of the tokenizers library and appends an end id.  ``write`` puts the
documents in ascending doc_id order over shards of like size (a range shuffle on doc_id, then on the text's hash, then
on the row, so that rows of one doc_id can be dealt to many shards) and saves them with the data source
``token_sequences``.  A shard is an Arrow stream file of record batches with two fixed-size-list columns, ``ids``
(uint16 where the vocabulary allows it, else uint32) and ``mask`` (bool, true where there is a token; a bit each): the
shard's tokens one after another, cut into sequences of ``length`` ids; only a shard's last sequence is padded.  All batches but the last have ``rows`` sequences and so the same
number of bytes, which is why batch k begins at head + k * step: ``Sequences`` maps a shard into memory and hands out any
sequence and its mask without copying or reading what lies before.  Beside each shard a second stream file lists its
documents (doc_id, start, n_tokens).  The manifest, written last by the commit, names the shards in order.

``documents`` and ``sequences`` read a saved folder as DataFrames, a task a shard.

The folder must be one that ``pyarrow.fs`` reaches from driver and executors: a shared mount, HDFS, S3 or GCS.  A task
writes files of its own name and reports them when they are closed, so lost executors and repeated tasks leave no trace
in the manifest; the commit deletes files that no task reported.

Words between ASCII white space are encoded one by one and remembered, which is exact because the vocabulary drops white
space before it splits and joins nothing across it.  Memory follows the longest run without white space.

Defined cases: a null or empty text has the end id only; rows of null doc_id come last; rows of equal doc_id are
documents of their own, ordered by the text's hash; an empty table makes a manifest without shards; a document may span
any number of sequences and batches; strings of special tokens in a text become those tokens, as the library has it;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusq.llm.common import prepare

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END, LENGTH, ROWS = 2, 1024, 64
#: Words that are remembered with their ids, and parts of words; the longest of them in bytes.
MEMO, WORD = 3 << 17, 64
#: Fixed value: the pattern by which vocabularies of this kind split words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters end here; none before combines with another.
SIMPLE = 0x250
#: A text is cut into words in pieces of about so many bytes.
PIECE = 1 << 20
#: Bytes of ids in a batch that is read back.
READ = 1 << 23
MANIFEST = "manifest.json"
NAME = "token_sequences"


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that end before white space."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw) and (m := _SPACE.search(raw, end)) is not None:
            end = m.start()
        elif end < len(raw):
            end = len(raw)
        yield raw[at:end]
        at = end


_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Remembers what a function gives for short keys, up to a number of them; then begins anew."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, key):
        got = self.of(key)
        if len(key) <= WORD:
            if len(self) >= MEMO:
                self.clear()
            self[key] = got
        return got


def simple(own) -> tuple[dict, dict, re.Pattern, re.Pattern]:
    """For code points below ``SIMPLE`` that the library normalizes one by one into one: what it makes of them, their
    bytes in its spelling, a pattern for words of them and the pattern that splits such words."""
    low, spelt, classes = {}, {}, {"L": "", "N": "", "": ""}
    for c in map(chr, range(0x21, SIMPLE)):
        n = own.normalizer.normalize_str(c)
        if len(n) == 1 and not n.isspace() and unicodedata.category(n)[0] not in "CM" and ord(n) < SIMPLE:
            low[ord(c)] = n
            spelt[ord(n)] = "".join(x for x, _ in own.pre_tokenizer.pre_tokenize_str(n))
            kind = unicodedata.category(n)[0]
            classes[kind if kind in "LN" else ""] += re.escape(n)
    split = rf"'s|'t|'re|'ve|'m|'ll|'d|[{classes['L']}]+|[{classes['N']}]|[{classes['']}]+"
    return low, spelt, re.compile("[" + "".join(re.escape(chr(c)) for c in low) + "]+"), re.compile(split)


@lru_cache(1)
def encoder(vocabulary: str):
    """A function from a text's bytes to its ids' bytes; vocabulary is the JSON of a tokenizer that drops white space.

    Words are normalized, split and encoded by the library's own parts.  Words of simple characters go through tables
    that the library fills, if the vocabulary has the usual steps: calls of the library cost more than its merges do.
    """
    from tokenizers import Tokenizer

    own, given = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
    special = re.compile(b"|".join(re.escape(x["content"].encode("utf-8")) for x in given["added_tokens"]) or rb"(?!)")
    usual = [x["type"] for x in given["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["pattern"]["Regex"] for x in given["pre_tokenizer"]["pretokenizers"] if "pattern" in x] == [PATTERN]
    model, normalizer, splitter = own.model, own.normalizer, own.pre_tokenizer
    model._resize_cache(0)
    low, spelt, plain, split = simple(own) if usual else ({}, {}, re.compile("(?!)"), None)
    parts = Memo(lambda p: packed([t.id for t in model.tokenize(p)]))

    def word(w: bytes) -> bytes:
        if usual and w.isalpha():  # letters of ASCII only
            return parts[w.lower().decode("ascii")]
        t = w.decode("utf-8")
        if special.search(w):
            return packed(own.encode(t, add_special_tokens=False).ids)
        if plain.fullmatch(t):
            return b"".join([parts[p.translate(spelt)] for p in split.findall(t.translate(low))])
        return b"".join([parts[p] for p, _ in splitter.pre_tokenize_str(normalizer.normalize_str(t))])

    words = Memo(word)

    def encode(text: bytes) -> bytes:
        return b"".join([b"".join(map(words.__getitem__, raw.split())) for raw in pieces(text)])

    return encode


def _encode(sent, end: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, last = encoder(sent.value), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = [encode(t or b"") + last for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, ids) of every document, in the order of the rows; ids are little-endian unsigned 32-bit integers."""
    spark = prepare(documents.sparkSession)
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode(sent, end), "doc_id bigint, ids binary")


def write(documents: DataFrame, folder: str, path: str = VOCABULARY, end: int = END, length: int = LENGTH, rows: int = ROWS, shards: int | None = None) -> None:
    """Save all documents in ascending doc_id order; one shuffle, of the texts.  Without ``shards``, sizes decide their number."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "r"]
    dealt = docs.repartitionByRange(shards, *order) if shards else docs.repartitionByRange(*order)
    ids = encode(dealt.sortWithinPartitions(*order), path, end)
    register(documents.sparkSession)
    ids.write.format(NAME).mode("append").option("length", length).option("rows", rows).option("bits", bits(path, end)).save(folder)


def bits(path: str, end: int) -> int:
    """Bits that every id of a vocabulary and the end id fit in."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return 16 if max(end, *given["model"]["vocab"].values(), *(x["id"] for x in given["added_tokens"])) < 1 << 16 else 32


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every saved document; start counts the ids of all documents before it."""
    return register(spark).read.format(NAME).option("view", "documents").load(folder)


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(sequence, ids, mask) of every saved sequence, numbered over all shards; ids as in ``encode``, mask a byte each."""
    return register(spark).read.format(NAME).option("view", "sequences").load(folder)


def report(documents_: DataFrame, folder: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files written for it."""
    spark = prepare(documents_.sparkSession)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/sequences-{uuid.uuid4().hex}"
    write(documents_, folder, path)
    return documents(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenSequences)
    return spark


def place(folder: str):
    """The file system of a folder and its path there; ``file:`` and paths without a scheme are local."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(folder)


def manifest(folder: str) -> dict:
    files, base = place(folder)
    with files.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class Message(WriterCommitMessage):
    """What a task wrote: its place in the order and the manifest's entry, or None for no document."""

    def __init__(self, order: int, entry: dict | None) -> None:
        self.order, self.entry = order, entry


class Shard:
    """Writes one shard: sequences as tokens come, documents as they end."""

    def __init__(self, files, base: str, name: str, length: int, rows: int, bits_: int) -> None:
        import pyarrow as pa

        self.pa, self.length, self.rows, self.name = pa, length, rows, name
        self.sink, self.sink_docs = files.open_output_stream(f"{base}/{name}.arrow"), files.open_output_stream(f"{base}/{name}.docs.arrow")
        schema = pa.schema([("ids", pa.list_(pa.uint16() if bits_ == 16 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(self.sink, schema)
        self.out_docs = pa.ipc.new_stream(self.sink_docs, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.block, self.filled = np.zeros(length * rows, np.uint16 if bits_ == 16 else np.uint32), 0
        self.head, self.step, self.batches, self.tokens, self.documents, self.sequences = schema.serialize().size, 0, 0, 0, 0, 0
        self.listed: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.listed.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.documents += 1
        while len(ids):
            k = min(len(ids), len(self.block) - self.filled)
            self.block[self.filled : self.filled + k] = ids[:k]
            self.filled, ids = self.filled + k, ids[k:]
            if self.filled == len(self.block):
                self._flush()
        if len(self.listed) >= 1 << 14:
            self._list()

    def _flush(self) -> None:
        pa, n = self.pa, -(-self.filled // self.length)
        mask = np.ones(n * self.length, bool)
        mask[self.filled :] = False
        self.block[self.filled :] = 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.block[: n * self.length], mask)]
        if self.batches and self.sink.tell() != self.head + self.batches * self.step:
            raise AssertionError("batches of one size must take the same number of bytes")
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))
        self.step = self.step or self.sink.tell() - self.head
        self.batches, self.sequences, self.filled = self.batches + 1, self.sequences + n, 0

    def _list(self) -> None:
        pa = self.pa
        columns = [pa.array(x, pa.int64()) for x in zip(*self.listed)] if self.listed else [pa.array([], pa.int64())] * 3
        self.out_docs.write_batch(pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens"]))
        self.listed = []

    def close(self) -> dict:
        if self.filled:
            self._flush()
        self._list()
        for x in (self.out, self.out_docs, self.sink, self.sink_docs):
            x.close()
        return {k: getattr(self, k) for k in ("name", "head", "step", "sequences", "tokens", "documents")}


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, length: int, rows: int, bits_: int) -> None:
        self.folder, self.length, self.rows, self.bits = folder, length, rows, bits_

    def write(self, iterator: Iterator) -> Message:
        files, base = place(self.folder)
        order, shard = TaskContext.get().partitionId(), None
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if shard is None:
                    files.create_dir(base, recursive=True)
                    shard = Shard(files, base, f"part-{order:06d}-{uuid.uuid4().hex}", self.length, self.rows, self.bits)
                shard.add(doc_id, np.frombuffer(ids.as_buffer(), "<u4"))
        return Message(order, shard and shard.close())

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, base = place(self.folder)
        files.create_dir(base, recursive=True)
        if files.get_file_info(f"{base}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.folder} holds sequences already")
        shards = [m.entry for m in sorted((m for m in messages if m is not None and m.entry), key=lambda m: m.order)]
        known = {f"{s['name']}{end}" for s in shards for end in (".arrow", ".docs.arrow")}
        for x in files.get_file_info(fs.FileSelector(base)):
            if x.base_name.startswith("part-") and x.base_name not in known:
                files.delete_file(x.path)
        with files.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"length": self.length, "rows": self.rows, "shards": shards}).encode())

    def abort(self, messages: list) -> None:
        files, base = place(self.folder)
        for m in messages:
            if m is not None and m.entry:
                for end in (".arrow", ".docs.arrow"):
                    files.delete_file(f"{base}/{m.entry['name']}{end}")


class Blocks:
    """The record batches of one shard by number: mapped into memory if local, else read by their places."""

    def __init__(self, folder: str, shard: dict) -> None:
        import pyarrow as pa
        from pyarrow import fs

        files, base = place(folder)
        path = f"{base}/{shard['name']}.arrow"
        self.pa, self.shard = pa, shard
        self.file = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.size = self.file.size()
        self.schema = pa.ipc.read_schema(self.file.read_buffer(shard["head"]))

    def __getitem__(self, k: int):
        """ids of batch k as a numpy array with a row a sequence, and mask as an Arrow array of all its bits; views of the mapped file."""
        at = self.shard["head"] + k * self.shard["step"]
        self.file.seek(at)
        part = self.file.read_buffer(min(self.shard["step"], self.size - at))
        batch = self.pa.ipc.read_record_batch(self.pa.ipc.read_message(part), self.schema)
        ids, mask = (c.flatten() for c in batch.columns)
        return ids.to_numpy(zero_copy_only=True).reshape(batch.num_rows, -1), mask


class Sequences:
    """Random access to all sequences of a folder, zero-copy over a local mount: ``len(s)``, and ``ids, mask = s[i]`` with ids
    as a numpy array and mask as an Arrow array of bits."""

    def __init__(self, folder: str) -> None:
        self.folder, m = folder, manifest(folder)
        self.length, self.rows, self.shards = m["length"], m["rows"], m["shards"]
        self.first = np.cumsum([0] + [s["sequences"] for s in self.shards])
        self.blocks: dict[int, Blocks] = {}

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int):
        if not 0 <= i < len(self):
            raise IndexError(i)
        s = int(np.searchsorted(self.first, i, "right")) - 1
        if s not in self.blocks:
            self.blocks[s] = Blocks(self.folder, self.shards[s])
        k, row = divmod(i - int(self.first[s]), self.rows)
        ids, mask = self.blocks[s][k]
        return ids[row], mask.slice(row * self.length, self.length)


class Part(InputPartition):
    def __init__(self, shard: dict, tokens: int, sequences: int) -> None:
        self.shard, self.tokens, self.sequences = shard, tokens, sequences


class Reader(DataSourceReader):
    def __init__(self, folder: str, view: str) -> None:
        self.folder, self.view = folder, view

    def partitions(self) -> list[Part]:
        out, tokens, n = [], 0, 0
        self.rows = (m := manifest(self.folder))["rows"]
        self.length = m["length"]
        for s in m["shards"]:
            out.append(Part(s, tokens, n))
            tokens, n = tokens + s["tokens"], n + s["sequences"]
        return out or [Part({}, 0, 0)]

    def read(self, partition: Part) -> Iterator:
        if partition.shard:
            yield from (self._documents if self.view == "documents" else self._sequences)(partition)

    def _sequences(self, p: Part) -> Iterator:
        import pyarrow as pa

        m, blocks, at = manifest(self.folder), Blocks(self.folder, p.shard), p.sequences
        for k in range(-(-p.shard["sequences"] // m["rows"])):
            ids, mask = blocks[k]
            n = len(ids)
            masks = mask.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), pa.array([x.tobytes() for x in ids.astype("<u4")], pa.binary()), pa.array([x.tobytes() for x in masks], pa.binary())], ["sequence", "ids", "mask"])
            at += n

    def _documents(self, p: Part) -> Iterator:
        import pyarrow as pa

        m, blocks = manifest(self.folder), Blocks(self.folder, p.shard)
        per, at, flat = m["length"] * m["rows"], -1, None

        def cut(start: int, n: int) -> bytes:
            nonlocal at, flat
            out = []
            while n:
                k, low = divmod(start, per)
                if k != at:
                    at, flat = k, blocks[k][0].reshape(-1)
                part = flat[low : low + n].astype("<u4")
                out.append(part.tobytes())
                start, n = start + len(part), n - len(part)
            return b"".join(out)

        files, base = place(self.folder)
        with files.open_input_stream(f"{base}/{p.shard['name']}.docs.arrow") as f, pa.ipc.open_stream(f) as listed:
            for batch in listed:
                rows, held, size = list(zip(*(c.to_pylist() for c in batch.columns))), [], 0
                for i, (doc_id, start, n) in enumerate(rows):
                    held.append((doc_id, p.tokens + start, cut(start, n)))
                    size += 4 * n
                    if size >= READ or i == len(rows) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])
                        held, size = [], 0


class TokenSequences(DataSource):
    """Options: ``length`` and ``rows`` when writing, ``view`` (documents or sequences) when reading."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary" if self._view() == "documents" else "sequence bigint, ids binary, mask binary"

    def _view(self) -> str:
        if (view := self.options.get("view", "documents")) not in ("documents", "sequences"):
            raise ValueError("view must be documents or sequences")
        return view

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._view())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("length", LENGTH)), int(self.options.get("rows", ROWS)), int(self.options.get("bits", 32)))
