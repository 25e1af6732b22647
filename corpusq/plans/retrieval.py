"""Composite searches: vector and keyword lists, fused, grouped and hydrated, in three profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import display_locator, extension, lines_between, locator_range, query_terms, query_terms_of, snippet, strip_page_markers
from corpusq.lineage import cut
from corpusq.operators import bm25, evaluation, fusion, vectors


def by_score() -> tuple:
    return F.round("score", 9).desc(), "chunk_id"


def lists(chunks: DataFrame, postings: DataFrame, vecs: DataFrame, vector: list[float], terms: list[str], k: int, profile: str, dirs: list[str] | None, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vector list (chunk_id, score) and the keyword list, k rows each."""
    where = None if dirs is None else F.col("dir_id").isin(*dirs)
    near = vectors.knn(vecs, vector, k, "cosine", "cloud" if profile == "cloud" else "local", where, key="chunk_id").select("chunk_id", "score")
    if lengths is not None and terms:
        # Only these postings are read, twice; where they are made from texts, those are cut into tokens once for both.
        postings = cut(postings.where(F.col("term").isin(*set(terms))))
    words = bm25.search(postings, terms, profile, dirs, k, lengths).select("chunk_id", "score")
    return near, words


def fuse(near: DataFrame, words: DataFrame) -> DataFrame:
    both = fusion.ranked(near, "vector", 0, "chunk_id").unionByName(fusion.ranked(words, "keyword", 1, "chunk_id"))
    return fusion.rrf(both).withColumnRenamed("id", "chunk_id")


def search(chunks: DataFrame, postings: DataFrame, vecs: DataFrame, vector: list[float], query: str, terms: list[str], top_k: int = 10, profile: str = "local", dirs: list[str] | None = None, keyword: str | None = None, reselect: bool = True, status: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Best files (``local``, ``library``) or chunks (``cloud``) with their text.

    ``local``: three times top_k rows a list, fused, grouped by file, and the representative chosen anew by bonus.
    ``library``: twice top_k, grouped, no new choice.  ``cloud``: twice top_k, chunks, and the status filter after the cut.
    """
    k = top_k * (3 if profile == "local" else 2)
    near, words = lists(chunks, postings, vecs, vector, terms, k, profile, dirs, lengths)
    fused = fuse(near, words)
    if profile == "cloud":
        best = fused.orderBy(F.round("score", 9).desc(), F.col("tie")).limit(top_k)
        out = best.join(chunks.select("chunk_id", "file_id", "content"), "chunk_id")
        if status is not None:
            out = out.join(status.where(F.col("status") == "indexed").select("file_id"), "file_id", "left_semi")
        return out.select("file_id", "chunk_id", "score", "sources", "content").orderBy(*by_score())
    items = fused.withColumn("ord", fusion.place(F.col("score"), F.col("tie"))).join(chunks.select("chunk_id", F.col("file_id").alias("file_key")), "chunk_id")
    files = fusion.group_by_file(items, top_k=top_k)
    if not (reselect and profile == "local"):
        return files.join(chunks.select("chunk_id", "content"), "chunk_id").select(F.col("file_key").alias("file_id"), "chunk_id", "score", "chunk_hits", "sources", "content").orderBy(*by_score())
    phrases = [p for p in (keyword, query) if p]
    found = items.join(words.select("chunk_id", F.lit(True).alias("hit")), "chunk_id", "left")
    texts = found.join(chunks.select("chunk_id", "content"), "chunk_id").select("chunk_id", "content", "score", (F.lit(keyword is not None) & F.coalesce("hit", F.lit(False))).alias("has_snippet"))
    best = fusion.reselect(files, texts, phrases, query_terms(query))
    out = best.join(files.select("file_key", "chunk_hits", "sources"), "file_key").join(chunks.select("chunk_id", "content"), "chunk_id")
    out = out.withColumn("snippet", snippet(F.col("content"), F.lit(keyword or query)))
    return out.select(F.col("file_key").alias("file_id"), "chunk_id", "score", "chunk_hits", "sources", "content", "snippet").orderBy(*by_score())


def search_many(chunks: DataFrame, postings: DataFrame, vecs: DataFrame, queries: DataFrame, top_k: int = 10, method: str = "hybrid", reselect: bool = True) -> DataFrame:
    """(query_id, rank, file_id, chunk_id, score, chunk_hits, sources): the best files of every query, in one plan.

    queries(query_id, text, terms, vector), postings of the ``local`` profile, vecs(chunk_id, embedding).  As ``search`` with
    the ``local`` profile: three times top_k rows a list, fused, grouped by file, the representative chosen anew by bonus.
    ``method`` keeps both lists (``hybrid``) or one (``vector``, ``keyword``).  Everything is keyed by query_id.
    """
    if method not in METHODS:
        raise ValueError("method must be hybrid, vector or keyword")
    return _best_files([f(postings, vecs, queries, 3 * top_k) for f in METHODS[method]], chunks, queries, top_k, reselect)


def _near(postings: DataFrame, vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    near = vectors.knn_many(vecs, queries.select("query_id", "vector"), k, key="chunk_id")
    return near.select("query_id", F.col("chunk_id").alias("id"), F.lit(0).alias("list_idx"), F.lit("vector").alias("list_name"), "rank")


def _words(postings: DataFrame, vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    words = bm25.search_many(postings, queries.select("query_id", F.explode("terms").alias("term")), k)
    return words.select("query_id", F.col("chunk_id").alias("id"), F.lit(1).alias("list_idx"), F.lit("keyword").alias("list_name"), "rank")


#: The lists that a method fuses.
METHODS = {"vector": (_near,), "keyword": (_words,), "hybrid": (_near, _words)}


def _best_files(parts: list[DataFrame], chunks: DataFrame, queries: DataFrame, top_k: int, reselect: bool = True) -> DataFrame:
    by = ("query_id",)
    fused = fusion.rrf(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), by=by).withColumnRenamed("id", "chunk_id")
    # At most 6 * top_k rows a query from here on.
    items = cut(fused.join(chunks.select("chunk_id", F.col("file_id").alias("file_key"), "content"), "chunk_id").withColumn("ord", fusion.place(F.col("score"), F.col("tie"))))
    files = fusion.group_by_file(items, top_k=top_k, by=by)
    out = files.select("query_id", "file_key", "chunk_id", "score", "chunk_hits", "sources")
    if reselect:
        asked = files.join(queries.select("query_id", F.array("text").alias("phrases"), query_terms_of(F.col("text")).alias("qt")), "query_id")
        texts = items.select("query_id", "chunk_id", "content", "score", F.lit(False).alias("has_snippet"))
        out = fusion.reselect(asked, texts, F.col("phrases"), F.col("qt"), by).join(files.select("query_id", "file_key", "chunk_hits", "sources"), ["query_id", "file_key"])
    order = Window.partitionBy("query_id").orderBy(*by_score())
    return out.select("query_id", F.row_number().over(order).alias("rank"), F.col("file_key").alias("file_id"), "chunk_id", "score", "chunk_hits", "sources")


def compare(chunks: DataFrame, postings: DataFrame, vecs: DataFrame, queries: DataFrame, expected: DataFrame, top_k: int = 10, methods: tuple[str, ...] = ("vector", "keyword", "hybrid")) -> DataFrame:
    """(method, queries, precision_at_k, precision_returned, recall_at_k, mrr) over expected(query_id, id) files.

    A list that several methods use is made once.
    """
    rows, made = None, {f: cut(f(postings, vecs, queries, 3 * top_k)) for f in dict.fromkeys(f for m in methods for f in METHODS[m])}
    for m in methods:
        hits = _best_files([made[f] for f in METHODS[m]], chunks, queries, top_k).select("query_id", F.col("file_id").alias("id"), "rank")
        one = evaluation.means(evaluation.per_query(hits, expected, top_k)).select(F.lit(m).alias("method"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def hydrate(items: DataFrame, chunks: DataFrame, archives: DataFrame, files: DataFrame) -> DataFrame:
    """items(file_id, chunk_id, ...) with path, the locator as it is shown, content without page markers, and the file's summary.

    The content is the chunk's lines of the archived text: items' own line_start and line_end where they hold a range,
    else those of the chunk, else what the locator names.  Line locators of converted documents are shown as the place
    that the archive's mapping has for most of these lines.  Unknown files and chunks give empty texts.
    """
    own = lambda c, t: F.col(c) if c in items.columns else F.lit(None).cast(t)
    ok = F.coalesce((own("line_start", "int") > 0) & (own("line_end", "int") >= own("line_start", "int")), F.lit(False))
    rows = items.withColumns({"__s": F.when(ok, own("line_start", "int")), "__e": F.when(ok, own("line_end", "int")), "__l": own("locator", "string")}).drop("line_start", "line_end", "locator", "path", "content", "summary")
    ranges = chunks.select("chunk_id", F.col("line_start").alias("__cs"), F.col("line_end").alias("__ce"), F.col("locator").alias("__cl"))
    whole = (F.col("__cs") > 0) & (F.col("__ce") >= F.col("__cs"))
    rows = rows.join(ranges, "chunk_id", "left").withColumns({"__s": F.coalesce("__s", F.when(whole, F.col("__cs"))), "__e": F.coalesce("__e", F.when(whole, F.col("__ce"))), "__l": F.coalesce("__l", "__cl", F.lit(""))})
    rows = rows.join(files.select("file_id", "path"), "file_id", "left").join(archives.select("file_id", F.col("content_md").alias("__t"), F.col("mapping").alias("__m"), "summary"), "file_id", "left")
    named = locator_range(F.trim("__l"))
    by_range, by_name = lines_between(F.col("__t"), F.col("__s"), F.col("__e")), lines_between(F.col("__t"), named["first"], named["last"])
    content = strip_page_markers(F.coalesce(F.nullif(by_range, F.lit("")), by_name, F.lit("")))
    first, last = F.coalesce("__s", named["first"]), F.coalesce("__e", named["last"])
    hits = F.transform("__m", lambda m, i: F.struct((F.least(m["end_line"], last) - F.greatest(m["start_line"], first) + 1).alias("n"), (-i).alias("i"), m["locator"].alias("locator")))
    best = F.array_max(F.filter(hits, lambda x: x["n"] > 0))["locator"]
    converted = extension(F.col("path")).isin("pdf", "doc", "docx", "xls", "xlsx") & named.isNotNull()
    shown = F.when(converted, F.coalesce(display_locator(best, F.col("path")), F.col("__l"))).otherwise(display_locator(F.col("__l"), F.col("path")))
    out = rows.withColumns({"content": content, "locator": F.coalesce(shown, "__l"), "path": F.coalesce("path", F.lit("")), "summary": F.coalesce("summary", F.lit(""))})
    return out.drop("__s", "__e", "__l", "__cs", "__ce", "__cl", "__t", "__m")


def file_snippets(hits: DataFrame, listed: DataFrame, keyword: str, chunks: DataFrame, archives: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """(file_id, snippets): of every listed file the best ``most`` keyword hits(file_id, chunk_id, score) as (chunk_id, locator, text)."""
    once = hits.groupBy("file_id", "chunk_id").agg(F.max("score").alias("score")).join(listed.select("file_id").distinct(), "file_id", "left_semi")
    texts = hydrate(once, chunks, archives, files).withColumn("text", snippet(F.col("content"), F.lit(keyword))).where("text <> ''")
    w = Window.partitionBy("file_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    top = texts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return top.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id", "locator", "text"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["locator"].alias("locator"), x["text"].alias("text"))).alias("snippets"))
