"""Indexing: scan, change detection, conversion, chunks, vectors, postings and metadata as one committed version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import chunk_id, file_id, headings, tokens_by_length
from corpusq.operators import changes, chunking, segmentation, tree
from corpusq.operators import postings as P
from corpusq.sources.catalog import Catalog
from corpusq.sources.files import Converters, scan
from corpusq.sources.imports import import_status


class HashingEmbedder:
    """A deterministic provider: signed hashed words, summed and normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimension] += 1 if h >> 16 & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(rows: DataFrame, text: str, provider, model: str = "hashing", batch: int = 64) -> DataFrame:
    """rows with content_vector; equal texts are embedded once, and providers are asked in batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            vectors = [v for a in range(0, len(texts), batch) for v in provider.embed(texts[a : a + batch])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float32()))], ["key", "content_vector"])

    keyed = rows.withColumn("key", F.concat_ws(":", F.lit(model), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    once = keyed.groupBy("key").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return keyed.join(once.mapInArrow(run, "key string, content_vector array<float>"), "key").drop("key")


def summary_input(markdown, most: int = 10000, head: int = 1000):
    """What a summary is made from: the text, or of a long one its beginning and its headings."""
    long = F.ceil(F.length(markdown) / 4) > most
    return F.when(long, F.concat_ws("\n\n", F.substring(markdown, 1, head * 4), F.array_join(headings(markdown), "\n"))).otherwise(markdown)


TEXTS = ["path", "relative_path", "dir", "size", "hash", "file_id", "markdown", "mapping", "error"]


def index(catalog: Catalog, root: str, project: str, converters: Converters | None = None, provider=None, least: int = 400, most: int = 800, style: str = "index", limit: int = 200 << 20) -> str | None:
    """Bring the catalog up to date with the files below root; unchanged files are skipped, removed ones purged.

    Returns the new version, or None if nothing has changed.  What a run that was stopped has converted and embedded is
    staged below the catalog by file and hash, and the next run takes it over: only what is missing is made.
    """
    spark = catalog.spark
    converters, provider = converters or Converters(), provider or HashingEmbedder()
    found = scan(spark, root, list(converters.by)).where("supported")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    # Hashed in the scan, so that no bytes are shuffled.
    hashed = found.join(raw.select("path", F.md5("content").alias("md5")), "path").select("path", "relative_path", "dir", "size", F.when(F.col("size") <= limit, F.col("md5")).otherwise(F.concat_ws(":", F.col("size").cast("string"), F.unix_millis("modified").cast("string"))).alias("hash"))
    now = hashed.withColumn("file_id", file_id(F.lit(project), F.col("relative_path")))
    before = catalog.read("files")
    archives = catalog.read("archives").select("file_id", F.lit(True).alias("archived"))
    state = changes.diff(now.select("file_id", "hash"), before.join(archives, "file_id", "left"), ["file_id"], archive="archived")
    state = catalog.stage(state)
    work = state.where("action in ('added', 'modified')").select("file_id")
    gone = state.where("action in ('removed', 'modified')").select("file_id")
    if state.where("action <> 'unchanged'").isEmpty():
        catalog.release()
        return None
    todo = now.join(work, "file_id", "left_semi")
    make = lambda rows: converters.convert(raw.join(rows.select("path"), "path", "left_semi")).join(rows, "path").select(*TEXTS)
    texts = _resumed(catalog, "texts", todo, make)
    return _commit(catalog, project, texts, gone, now.select("relative_path"), provider, least, most, style)


def _resumed(catalog: Catalog, kind: str, todo: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows for todo(file_id, hash): those that an earlier run staged, and for the rest what make gives, staged."""
    old = catalog.staged(kind)
    if old is None:
        return catalog.stage(make(todo), kind)
    old = old.join(todo.select("file_id", "hash"), ["file_id", "hash"], "left_semi")
    known = catalog.stage(old.select("file_id", "hash").distinct())
    rest = todo.join(known, ["file_id", "hash"], "left_anti")
    return old if rest.isEmpty() else old.unionByName(catalog.stage(make(rest), kind))


def _commit(catalog: Catalog, project: str, texts: DataFrame, gone: DataFrame, paths: DataFrame, provider, least: int, most: int, style: str) -> str:
    """New versions of all tables: without the files of gone(file_id), with those of texts(TEXTS); paths are all files'."""
    style, learned = _segmenter(catalog, texts, style)
    dirs = tree.directories(paths.select(F.lit(project).alias("project_id"), F.col("relative_path").alias("path")), catalog.read("directories"))
    # Converted, embedded and split once: chunks, postings, archives and files are all made from these.
    texts = texts.join(dirs.select("dir_id", F.col("relative_path").alias("dir")), "dir")
    ok = texts.where("error is null")
    settings = f"{type(provider).__name__}-{getattr(provider, 'model', '')}-{getattr(provider, 'dimension', '')}-{least}-{most}"

    def split(rows: DataFrame) -> DataFrame:
        own = ok.join(rows.select("file_id"), "file_id", "left_semi")
        return embed(chunking.chunk_files(own.select("file_id", F.col("markdown").alias("content")), least, most), "content", provider).join(rows.select("file_id", "hash"), "file_id")

    pieces = _resumed(catalog, f"pieces-{hashlib.sha256(settings.encode()).hexdigest()[:16]}", ok.select("file_id", "hash"), split)
    pieces = pieces.drop("hash").join(ok.select("file_id", "dir_id", F.col("relative_path").alias("rel_path")), "file_id")
    pieces = pieces.withColumns({"indexed_at": F.current_timestamp(), "deleted_at": F.lit(None).cast("timestamp")})
    keep = lambda name: catalog.read(name).join(gone, "file_id", "left_anti")
    chunks = keep("chunks").unionByName(pieces.select(*catalog.schema("chunks").names))
    words = P.build(pieces.select("file_id", "dir_id", "chunk_id", "locator", "content"), style)
    posts = keep("postings").unionByName(words.select(*catalog.schema("postings").names))
    store = ok.select("file_id", F.col("markdown").alias("content_md"), "mapping", F.lit(None).cast("string").alias("summary"), F.concat(F.lit("sha256:"), F.sha2(F.col("markdown").cast("binary"), 256)).alias("source_hash"))
    n = pieces.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"))
    rows = texts.join(n, "file_id", "left").select(
        "file_id", "dir_id", F.element_at(F.split("relative_path", "/"), -1).alias("name"), F.col("relative_path").alias("path"), F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1)).alias("type"), "size", "hash",
        F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(None).cast("string").alias("summary"), F.col("error").alias("error_message"), F.current_timestamp().alias("indexed_at"),
    )
    files = keep("files").unionByName(rows)
    counts = tree.rollup(files.select(F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".").alias("relative_path"), F.lit(1).cast("bigint").alias("file_count"), F.col("chunk_count").cast("bigint").alias("chunk_count")), "relative_path", "file_count", "chunk_count")
    up = dirs.select(F.col("relative_path").alias("above"), F.col("dir_id").alias("parent_dir_id"))
    folder = F.when(F.col("relative_path") == ".", F.lit(None)).when(F.col("relative_path").contains("/"), F.regexp_replace("relative_path", r"/[^/]*$", "")).otherwise(".")
    metas = dirs.withColumn("above", folder).join(up, "above", "left").join(counts, "relative_path", "left").withColumn("summary", F.lit(None).cast("string")).fillna(0, ["file_count", "chunk_count"])
    version = catalog.commit(chunks=chunks, postings=posts, archives=keep("archives").unionByName(store), files=files, directories=metas, **learned)
    catalog.release()
    return version


def _segmenter(catalog: Catalog, texts: DataFrame, style: str):
    """With the style ``words``, a segmenter over the catalog's lexicon, which the first run learns from its texts and commits.

    The lexicon stays as it is from then on, so that new postings and queries are cut as the old ones were.
    """
    if style != "words":
        return style, {}
    known, learned = catalog.read("lexicon"), {}
    if known.isEmpty():
        counts = catalog.stage(segmentation.ngrams(texts.where("error is null"), "markdown"))
        known = catalog.stage(segmentation.lexicon(counts))
        learned = {"lexicon": known}
    return segmentation.Segmenter.of(known), learned


def ingest(catalog: Catalog, project: str, fetched: DataFrame, folder: str = "urls", converters: Converters | None = None, provider=None, least: int = 400, most: int = 800, style: str = "index") -> str:
    """Commit fetched(url, content, error) as files below a folder, a row for each URL; what could not be had has status ``failed``.

    A URL's file is named after its last part and a hash of the whole, so that fetching it again replaces it.  Without an
    extension that a converter has, it counts as text.
    """
    converters, provider = converters or Converters(), provider or HashingEmbedder()
    last = F.regexp_replace(F.coalesce(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1), F.lit("")), r"[^A-Za-z0-9._-]", "_")
    kind = F.lower(F.regexp_extract(last, r"\.([^.]+)$", 1))
    name = F.concat(F.regexp_replace(last, r"\.[^.]*$", ""), F.lit("-"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 8), F.lit("."), F.when(kind.isin(*converters.by), kind).otherwise("txt"))
    rows = fetched.where("url is not null").dropDuplicates(["url"]).select(F.col("url").alias("path"), F.concat_ws("/", F.lit(folder), name).alias("relative_path"), F.lit(folder).alias("dir"), F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("size"), F.coalesce(F.md5("content"), F.lit("")).alias("hash"), "content", "error")
    rows = catalog.stage(rows.withColumn("file_id", file_id(F.lit(project), F.col("relative_path"))))
    had = rows.where("error is null")
    made = converters.convert(had.select(F.col("relative_path").alias("path"), "content")).withColumnRenamed("path", "relative_path")
    ok = had.drop("content", "error").join(made, "relative_path").select(*TEXTS)
    bad = rows.where("error is not null").select(*TEXTS[:6], F.lit("").alias("markdown"), F.lit(None).cast(ok.schema["mapping"].dataType).alias("mapping"), "error")
    texts = catalog.stage(ok.unionByName(bad))
    paths = catalog.read("files").select(F.col("path").alias("relative_path")).unionByName(rows.select("relative_path")).distinct()
    return _commit(catalog, project, texts, rows.select("file_id"), paths, provider, least, most, style)


def import_rows(catalog: Catalog, project: str, rows: DataFrame, style: str = "index") -> str:
    """Commit ready chunks: rows(path, idx, content, locator, line_start, line_end, content_vector, hash) of files that others made.

    Files that are there already are replaced.  A file whose chunks all have vectors is ``indexed``, another ``embedding``.
    """
    rows = catalog.stage(rows.withColumn("file_id", file_id(F.lit(project), F.col("path"))))
    gone = rows.select("file_id").distinct()
    paths = catalog.read("files").select("path").unionByName(rows.select("path")).distinct()
    dirs = tree.directories(paths.select(F.lit(project).alias("project_id"), "path"), catalog.read("directories"))
    placed = rows.withColumn("dir", tree.folder_of(F.col("path"))).join(dirs.select("dir_id", F.col("relative_path").alias("dir")), "dir")
    keep = lambda name: catalog.read(name).join(gone, "file_id", "left_anti")
    pieces = placed.select(chunk_id(F.col("file_id"), F.col("idx")).alias("chunk_id"), "file_id", "dir_id", F.col("idx").cast("int").alias("idx"), F.col("path").alias("rel_path"), "line_start", "line_end", "locator", "content", tokens_by_length(F.col("content")).cast("int").alias("tokens"), "content_vector", F.current_timestamp().alias("indexed_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    words = P.build(pieces.select("file_id", "dir_id", "chunk_id", "locator", "content"), style)
    texts = placed.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), "\n").alias("content_md"))
    store = texts.select("file_id", "content_md", F.lit(None).cast("array<struct<start_line:int,end_line:int,locator:string>>").alias("mapping"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("sha256:"), F.sha2(F.col("content_md").cast("binary"), 256)).alias("source_hash"))
    about = placed.groupBy("file_id").agg(F.first("dir_id").alias("dir_id"), F.first("path").alias("path"), F.max("hash").alias("hash"), F.sum(F.octet_length("content")).cast("bigint").alias("size"))
    files = about.join(import_status(pieces), "file_id").select("file_id", "dir_id", F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("type"), "size", "hash", "status", "chunk_count", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("indexed_at"))
    every = keep("files").unionByName(files)
    counts = tree.rollup(every.select(tree.folder_of(F.col("path")).alias("relative_path"), F.lit(1).cast("bigint").alias("file_count"), F.col("chunk_count").cast("bigint").alias("chunk_count")), "relative_path", "file_count", "chunk_count")
    above = F.when(F.col("relative_path") != ".", tree.folder_of(F.col("relative_path")))
    metas = dirs.withColumn("above", above).join(dirs.select(F.col("relative_path").alias("above"), F.col("dir_id").alias("parent_dir_id")), "above", "left").join(counts, "relative_path", "left").withColumn("summary", F.lit(None).cast("string")).fillna(0, ["file_count", "chunk_count"])
    version = catalog.commit(chunks=keep("chunks").unionByName(pieces), postings=keep("postings").unionByName(words.select(*catalog.schema("postings").names)), archives=keep("archives").unionByName(store), files=every, directories=metas)
    catalog.release()
    return version


def backfill(rows: DataFrame, summarise: Callable[[list[str]], list[str]], text: str = "content_md") -> DataFrame:
    """Summaries where they are missing or blank; a failed one is the empty string."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            try:
                got = summarise(b.column(1).to_pylist())
            except Exception:
                got = [""] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["file_id", "__s"])

    need = rows.where(F.trim(F.coalesce("summary", F.lit(""))) == "").select("file_id", summary_input(F.col(text)).alias("t"))
    made = need.mapInArrow(run, "file_id string, __s string")
    return rows.join(made, "file_id", "left").withColumn("summary", F.coalesce("__s", "summary")).drop("__s")
