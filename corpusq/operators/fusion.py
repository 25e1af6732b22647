"""Reciprocal rank fusion, grouping by file, and choice of the representative chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import heading_text, structured

K, BOOST = 60, 0.35


def ranked(rows: DataFrame, name: str, index: int, key: str, score: str = "score") -> DataFrame:
    """A scored list as (id, list_idx, list_name, rank)."""
    w = Window.orderBy(F.round(score, 9).desc(), key)
    return rows.select(F.col(key).alias("id"), F.lit(index).alias("list_idx"), F.lit(name).alias("list_name"), F.row_number().over(w).alias("rank"))


def rrf(lists: DataFrame, k: int = K, by: tuple[str, ...] = ()) -> DataFrame:
    """lists(id, list_idx, list_name, rank) to (id, score, sources), and the key by which equal scores are ordered.

    ``by`` names further keys, such as a query's, in this and the functions below.
    """
    return lists.groupBy(*by, "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.transform(F.array_sort(F.collect_set(F.struct("list_idx", "list_name"))), lambda x: x["list_name"]).alias("sources"),
        F.min(F.struct("list_idx", "rank")).alias("tie"),
    )


def place(score: Column, tie: Column) -> Column:
    """A value that orders a fused list without numbering it, so that no task sees the whole list."""
    return F.struct((-F.round(score, 9)).alias("s"), tie.alias("t"))


def group_by_file(items: DataFrame, factor: float = BOOST, top_k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """items(chunk_id, file_key, score, ord, sources) to one row per file.

    The score is the best chunk's plus ``factor`` (0 to 1) of the others'; ord is the order of the fused list, a number or
    any value that orders it.  A blank file key stands for the chunk alone.
    """
    factor = min(max(factor, 0.0), 1.0)
    key = F.when(F.trim(F.coalesce("file_key", F.lit(""))) == "", F.concat(F.lit("__chunk__:"), F.col("chunk_id"))).otherwise(F.trim("file_key"))
    first = F.struct((-F.round("score", 9)).alias("s"), "ord", "score", "chunk_id")
    rows = items.withColumn("file_key", key).groupBy(*by, "file_key").agg(
        F.sum("score").alias("total"),
        F.min(first).alias("rep"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.min("ord").alias("ord"),
    )
    ids = F.array_distinct("ids")
    out = rows.select(*by, "file_key", F.col("rep.chunk_id").alias("chunk_id"), (F.col("rep.score") + F.greatest(F.lit(0.0), F.col("total") - F.col("rep.score")) * factor).alias("score"), F.size(ids).alias("chunk_hits"), ids.alias("chunk_ids"), "sources", "ord")
    if top_k is None:
        return out
    if top_k <= 0:
        return out.limit(0)
    order = (F.round("score", 9).desc(), "ord")
    if not by:
        return out.orderBy(*order).limit(top_k)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top_k)


def bonus(content: Column, has_snippet: Column, phrases: list[str], terms: list[str]) -> Column:
    """How much a chunk gains as representative: snippet, exact phrases by place, query terms in heading and lead."""
    head, lead = heading_text(content), F.substring(content, 1, 200)
    out = F.when(has_snippet, F.lit(0.02)).otherwise(F.lit(0.0))
    for p in (p.strip() for p in phrases):
        if len(p) >= 2:
            out = out + F.when(content.contains(p), 0.008).otherwise(0.0) + F.when(lead.contains(p), 0.012).otherwise(0.0) + F.when(head.contains(p), 0.016).otherwise(0.0)
    count = lambda where: sum((F.when(where.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    out = out + F.least(count(head), F.lit(3)) * 0.004 + F.least(count(lead), F.lit(4)) * 0.002
    return out + F.when((count(head) > 0) & structured(head), 0.006).otherwise(0.0)


def bonus_by_row(content: Column, has_snippet: Column, phrases: Column, terms: Column) -> Column:
    """``bonus`` with phrases and terms from arrays."""
    head, lead = heading_text(content), F.substring(content, 1, 200)
    add = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda a, x: a + x)
    held = lambda where, weight: (lambda p: F.when(F.contains(where, F.trim(p)), weight).otherwise(0.0))
    fit = F.filter(phrases, lambda p: F.length(F.trim(p)) >= 2)
    out = F.when(has_snippet, F.lit(0.02)).otherwise(F.lit(0.0))
    for where, weight in ((content, 0.008), (lead, 0.012), (head, 0.016)):
        out = out + add(fit, held(where, weight))
    count = lambda where: F.size(F.filter(terms, lambda t: F.contains(where, t)))
    out = out + F.least(count(head), F.lit(3)) * 0.004 + F.least(count(lead), F.lit(4)) * 0.002
    return out + F.when((count(head) > 0) & structured(head), 0.006).otherwise(0.0)


def reselect(files: DataFrame, chunks: DataFrame, phrases: list[str] | Column, terms: list[str] | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Every file's chunk of the highest bonus, then score, then place; the bonus is added to the file's score.

    files are rows of ``group_by_file``; chunks(chunk_id, content, score, has_snippet).  Phrases and terms are those of the
    query, or, with ``by``, array columns of files.
    """
    asked = [phrases.alias("__phrases"), terms.alias("__terms")] if isinstance(phrases, Column) else []
    rows = files.select(*by, "file_key", F.col("score").alias("file_score"), *asked, F.posexplode("chunk_ids").alias("at", "chunk_id")).join(chunks, [*by, "chunk_id"])
    gain = bonus_by_row(F.col("content"), F.col("has_snippet"), F.col("__phrases"), F.col("__terms")) if asked else bonus(F.col("content"), F.col("has_snippet"), phrases, terms)
    best = rows.withColumn("bonus", gain).groupBy(*by, "file_key").agg(F.max(F.struct(F.round("bonus", 9), F.round("score", 9), -F.col("at"), "chunk_id", "bonus", "file_score")).alias("b"))
    return best.select(*by, "file_key", "b.chunk_id", (F.col("b.file_score") + F.col("b.bonus")).alias("score"), "b.bonus")


def snippets(files: DataFrame, keyword_hits: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` keyword hits(file_key, chunk_id, rank, ...) of each listed file, in rank order."""
    w = Window.partitionBy("file_key").orderBy("rank")
    return keyword_hits.join(files.select("file_key"), "file_key", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def best_per_chunk(rows: DataFrame, least: float = 0.0, top_k: int | None = None) -> DataFrame:
    """(chunk_id, score): the highest score of every chunk over several lists(chunk_id, score), best first.

    Scores below ``least`` don't count; 0 or less keeps all.
    """
    kept = rows.where(F.col("score") >= least) if least > 0 else rows
    best = kept.groupBy("chunk_id").agg(F.max("score").alias("score"))
    return best if top_k is None else best.orderBy(F.col("score").desc(), "chunk_id").limit(top_k)
