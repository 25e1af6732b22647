"""Stored postings for pruned ranking: each term's list by falling impact, in blocks with the block's highest impact.

An impact is what a posting adds to its chunk's BM25 score, fixed when the table is made, as idf and mean length are those
of the whole index.  ``blocks`` orders all postings by term and falling impact with one range shuffle, so that a hot
term spreads over as many partitions as it needs, and packs them while they stream by; in a Parquet table written from it,
a term's rows stand together and the columns' statistics let a scan skip what a filter on term and highest impact
excludes.

``search`` is exact.  The first blocks of the query's lists give sums, the k-th highest of which, s, is a lower bound of the
k-th score.  A chunk of score s or more has in each of its lists an impact that with the highest of the query's other lists
reaches s, so only blocks that can hold such an impact have to be read.  While these are more than the blocks that gave s,
four times as many give a better one; then they are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import tokens
from corpusq.operators import bm25
from corpusq.operators import postings as P

SIZE = 128
SCHEMA = "term string, highest double, n int, chunk_ids array<string>, file_ids array<string>, impacts array<double>"
#: Sums of doubles in another order may differ by less.
SLACK = 1e-7
#: Terms in at least one of so many files have their frequencies broadcast; they number at most this times a file's mean terms.
OFTEN = 4096


def _pack(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ("term", "highest", "n", "chunk_ids", "file_ids", "impacts")
        kinds = (pa.string(), pa.string(), pa.float64())
        held = None

        def out(table, cuts):
            first, last = np.array(cuts[:-1]), np.array(cuts[1:])
            columns = [table.column(c).combine_chunks().cast(t) for c, t in zip(("chunk_id", "file_id", "impact"), kinds)]
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([table.column("term").combine_chunks().take(pa.array(first)), columns[2].take(pa.array(first)), pa.array(last - first, pa.int32()), *lists], list(names))

        def cuts_of(table) -> list[int]:
            terms = table.column("term").combine_chunks().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(terms[1:] != terms[:-1]) + 1), len(terms)]
            return [int(x) for a, b in zip(edges, edges[1:]) for x in range(a, b, size)] + [len(terms)]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            cuts = cuts_of(table)
            held = table.slice(cuts[-2])
            if len(cuts) > 2:
                yield out(table.slice(0, cuts[-2]), cuts[:-1])
        if held is not None and held.num_rows:
            yield out(held, [0, held.num_rows])

    return run


def blocks(postings: DataFrame, lengths: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of ``SCHEMA`` from postings of the ``local`` profile and lengths(file_id, length)."""
    return _blocks(postings, P.document_frequency(postings), lengths, size)


def _runs(rows: DataFrame) -> DataFrame:
    """With a column ``s`` of sorted tokens as ``terms``, each once, and ``counts``; both null where s is."""
    n = F.size("s")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.withColumn("at", F.when(n > 0, starts).when(n == 0, F.array().cast("array<int>")))
    return rows.withColumns({"terms": F.array_distinct("s"), "counts": F.transform("at", lambda i, k: F.coalesce(F.get("at", k + 1), n) - i)}).drop("s", "at")


def blocks_of(chunks: DataFrame, style: str = "index", size: int = SIZE) -> DataFrame:
    """``blocks`` of the postings of chunks(file_id, chunk_id, content), which are not made for it.

    Terms are counted in place, as runs of a text's sorted tokens, and brought together by file as lines of one text, which
    compresses well; so no token may hold a line end.  Neither positions nor single tokens are shuffled, and files by term are
    counted before their shuffle.
    """
    rows = _runs(chunks.select("file_id", "chunk_id", F.sort_array(tokens(F.col("content"), style)).alias("s")))
    rows = rows.select("file_id", "chunk_id", F.array_join("terms", "\n").alias("words"), "counts").repartition("file_id")
    whole = rows.groupBy("file_id", "chunk_id").agg(F.collect_list(F.when(F.size("counts") > 0, F.struct("words", "counts"))).alias("e")).where(F.size("e") > 0)
    # Entries of one chunk, which are rare, are merged as tokens.
    again = lambda x: F.flatten(F.transform(F.split(x["words"], "\n"), lambda w, k: F.array_repeat(w, F.get(x["counts"], k))))
    both = _runs(whole.withColumn("s", F.when(F.size("e") > 1, F.sort_array(F.flatten(F.transform("e", again))))))
    one = F.get("e", F.lit(0))
    own = both.select("file_id", "chunk_id", F.coalesce("terms", F.split(one["words"], "\n")).alias("terms"), F.coalesce("counts", one["counts"]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    files = own.groupBy("file_id").agg(F.collect_list(F.struct("chunk_id", "terms", "counts")).alias("chunks"), F.sum(total).alias("length"))
    df = files.select(F.explode(F.array_distinct(F.flatten("chunks.terms"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rows = files.select("file_id", F.col("length").alias("doc_length"), F.explode("chunks").alias("c"))
    flat = rows.select("file_id", "doc_length", "c.chunk_id", F.explode(F.arrays_zip("c.terms", "c.counts")).alias("t"))
    counts = flat.select(F.col("t.terms").alias("term"), "file_id", "chunk_id", F.col("t.counts").cast("bigint").alias("tf"), "doc_length")
    return _blocks(counts, df, files.select("file_id", "length"), size)


def _blocks(postings: DataFrame, df: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """Only postings of rare terms are shuffled for their frequencies, and the range shuffle takes counts, not impacts."""
    stats = F.broadcast(lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")))
    weighed, often = df.crossJoin(stats), F.col("df") * OFTEN >= F.col("n")
    known = F.broadcast(weighed.where(often))
    rows = postings.join(known, "term").unionByName(postings.join(known.select("term"), "term", "left_anti").join(weighed.where(~often), "term"))
    rows = rows.select("term", "chunk_id", F.nullif("file_id", "chunk_id").alias("file_id"), "tf", "doc_length", "df", "n", "mean")
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    impact = bm25.term_score(F.col("tf"), F.col("doc_length"), mean, bm25.idf(F.col("n"), F.col("df")))
    rows = rows.repartitionByRange("term", impact.desc(), "chunk_id").select("term", "chunk_id", "file_id", impact.alias("impact"))
    rows = rows.sortWithinPartitions("term", F.col("impact").desc(), "chunk_id").withColumn("file_id", F.coalesce("file_id", "chunk_id"))
    return rows.mapInArrow(_pack(size), SCHEMA)


def _hits(rows: DataFrame, weights: dict[str, int]) -> DataFrame:
    qn = F.element_at(F.create_map(*[x for t, c in weights.items() for x in (F.lit(t), F.lit(c))]), F.col("term"))
    flat = rows.select(qn.alias("qn"), F.explode(F.arrays_zip("chunk_ids", "file_ids", "impacts")).alias("p"))
    return flat.groupBy(F.col("p.file_ids").alias("file_id"), F.col("p.chunk_ids").alias("chunk_id")).agg(F.sum(F.col("qn") * F.col("p.impacts")).alias("score"))


def needed(table: DataFrame, terms: list[str], k: int) -> Column | None:
    """The blocks that a search for the k best has to read, as a filter on term and highest impact; None if no term is known.

    What comes to the driver is a row for each term of the query, and a number, a few times over.
    """
    weights = dict(Counter(terms))
    rows = table.where(F.col("term").isin(*weights))
    lists = rows.groupBy("term").agg(F.max("highest").alias("top"), F.count("*").alias("blocks")).collect()
    if not lists:
        return None
    tops = {r.term: weights[r.term] * r.top for r in lists}
    whole, most, n = sum(tops.values()), max(r.blocks for r in lists), -(-k // SIZE) + 1
    w = Window.partitionBy("term").orderBy(F.col("highest").desc(), F.get("chunk_ids", F.lit(0)))
    while True:
        heads = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)
        least = _hits(heads, weights).select("score").orderBy(F.col("score").desc()).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).head()
        s = least.s - SLACK if least.n == k else 0.0
        keep = reduce(or_, [(F.col("term") == t) & (F.col("highest") >= (s - (whole - top)) / weights[t]) for t, top in tops.items()])
        # More of the lists can only raise s, which matters until no list needs more than was read of it.
        if n >= most or (rows.where(keep).groupBy("term").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0) <= n:
            return keep
        n *= 4


def search(table: DataFrame, terms: list[str], top_k: int) -> DataFrame:
    """(file_id, chunk_id, score): as ``bm25.search`` over all directories, with the ``local`` profile."""
    keep = needed(table, terms, top_k) if terms and top_k > 0 else None
    if keep is None:
        return table.select(F.lit("").alias("file_id"), F.lit("").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    return _hits(table.where(keep), dict(Counter(terms))).where("score > 0").orderBy(F.round("score", 9).desc(), "chunk_id").limit(top_k)


def reads(table: DataFrame, terms: list[str], top_k: int) -> DataFrame:
    """(term, blocks, read): of each of the query's terms, its blocks and those that the second pass reads."""
    keep = needed(table, terms, top_k)
    rows = table.where(F.col("term").isin(*set(terms)))
    return rows.groupBy("term").agg(F.count("*").alias("blocks"), F.count_if(F.lit(False) if keep is None else keep).alias("read"))
