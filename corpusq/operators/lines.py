"""Line tools over texts: grep, glob, reading, neighbours, paragraphs, sections, boilerplate, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import boilerplate_line, glob_regex, line_slice, lines


def grep(files: DataFrame, needle: str, path: str = "path", case_sensitive: bool = False, context: int = 2, limit: int | None = None) -> DataFrame:
    """Lines that hold the needle as it is written: (path, line_no from 1, line, before, after), in path and line order.

    An empty needle finds every line.
    """
    rows = files.withColumn("__lines", lines(F.col("content"))).select(path, "__lines", F.posexplode("__lines").alias("__i", "line"))
    test = F.contains("line", F.lit(needle)) if case_sensitive else F.contains(F.lower("line"), F.lit(needle.lower()))
    a = F.greatest(F.col("__i") - context, F.lit(0))
    out = rows.where(test).select(
        path,
        (F.col("__i") + 1).alias("line_no"),
        "line",
        F.slice("__lines", a + 1, F.col("__i") - a).alias("before"),
        F.slice("__lines", F.col("__i") + 2, F.lit(context)).alias("after"),
    )
    return out if limit is None else out.orderBy(path, "line_no").limit(limit)


def glob(files: DataFrame, pattern: str, path: str = "path", limit: float | None = 100) -> DataFrame:
    out = files.where(F.col(path).rlike(glob_regex(pattern)))
    return out if limit is None else out.orderBy(path).limit(max(1, int(limit)))


def select_files(files: DataFrame, file_id: str | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Files by id, path and pattern, all of which must hold."""
    for test in (file_id is not None and (F.col("file_id") == file_id), path is not None and (F.col("path") == path), pattern is not None and F.col("path").rlike(glob_regex(pattern))):
        files = files if test is False else files.where(test)
    return files


def read_lines(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """content cut to lines first..last, with total_lines."""
    n = F.size(lines(F.col("content")))
    part = line_slice(F.col("content"), F.lit(first or 1), n if last is None else F.lit(last))
    return files.withColumn("total_lines", n).withColumn("content", part)


def neighbours(chunks: DataFrame, hits: DataFrame, n: int, file: str = "file_id", index: str = "idx") -> DataFrame:
    """For hits(file, index) the chunks up to n places before and after: an equi-join on the places, not a range scan."""
    around = hits.select(F.col(file), F.col(index).alias("hit_idx"), F.explode(F.sequence(F.col(index) - n, F.col(index) + n)).alias(index)).where(F.col(index) != F.col("hit_idx"))
    return around.join(chunks, [file, index])


def paragraphs(files: DataFrame, key: str) -> DataFrame:
    """Runs of non-blank lines: (key, first_line, last_line, text), lines from 1."""
    rows = files.select(key, F.posexplode(lines(F.col("content"))).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    blank = F.trim("line") == ""
    rows = rows.withColumn("island", F.sum(blank.cast("int")).over(w)).where(~blank)
    got = rows.groupBy(key, "island").agg((F.min("i") + 1).alias("first_line"), (F.max("i") + 1).alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return got.drop("island")


def sections(files: DataFrame, key: str) -> DataFrame:
    """Sections from one ATX heading to the next: (key, section, level, title, first_line, last_line); 0 is what stands before."""
    rows = files.select(key, F.posexplode(lines(F.col("content"))).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    p = r"^(#{1,6})\s+(.+)$"
    rows = rows.withColumn("fence", F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(w))
    head = F.col("line").rlike(p) & (F.col("fence") % 2 == 0)
    rows = rows.withColumn("head", head).withColumn("section", F.sum(head.cast("int")).over(w))
    got = rows.groupBy(key, "section").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.max(F.when(F.col("head"), F.col("line"))).alias("line"))
    return got.select(key, "section", F.length(F.regexp_extract("line", p, 1)).alias("level"), F.regexp_extract("line", p, 2).alias("title"), (F.col("a") + 1).alias("first_line"), (F.col("b") + 1).alias("last_line"))


def boilerplate(pages: DataFrame, key: str, page: str, share: float = 0.6) -> DataFrame:
    """Lines (in normal form) that stand on at least max(2, ceil(share * pages)) pages of a document."""
    n = pages.groupBy(key).agg(F.count_distinct(page).alias("pages"))
    rows = pages.select(key, page, F.explode(lines(F.col("content"))).alias("line")).withColumn("line", boilerplate_line(F.col("line"))).where("line <> ''").distinct()
    counts = rows.groupBy(key, "line").agg(F.count("*").alias("n"))
    return counts.join(n, key).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).select(key, "line", "n")


def strip_boilerplate(text: Column, known: Column) -> Column:
    """Without the leading and trailing lines whose normal form is known (or blank)."""
    flags = F.transform(lines(text), lambda x: (boilerplate_line(x) != "") & ~F.array_contains(known, boilerplate_line(x)))
    a = F.array_position(flags, True)
    b = F.size(flags) - F.array_position(F.reverse(flags), True) + 1
    return F.when(a == 0, "").otherwise(F.array_join(F.slice(lines(text), a.cast("int"), F.greatest((b - a + 1).cast("int"), F.lit(0))), "\n"))


def page_offsets(pages: DataFrame, key: str, page: str, separator: int = 1) -> DataFrame:
    """First and last line of every page once a document's pages are joined with ``separator`` lines between."""
    w = Window.partitionBy(key).orderBy(page)
    n = F.size(lines(F.col("content")))
    before = F.coalesce(F.sum(n + separator).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.select(key, page, (before + 1).alias("first_line"), (before + n).alias("last_line"))


def page_changes(rows: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """Rows at which the page differs from the row before: where a marker goes in."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(page).over(w)).where(F.col("before").isNull() | (F.col("before") != F.col(page)))


def page_class(characters: Column, least: int = 100) -> Column:
    return F.when(characters >= least, "text").otherwise("scan")


def document_class(kinds: DataFrame, key: str) -> DataFrame:
    """text, scan or mixed, from (key, kind) of the pages."""
    n, t = F.count("*"), F.count_if(F.col("kind") == "text")
    return kinds.groupBy(key).agg(F.when(t == n, "text").when(t == 0, "scan").otherwise("mixed").alias("kind"))


def best_overlap(ranges: DataFrame, mapping: DataFrame, file: str = "file_id", width: int = 64) -> DataFrame:
    """For ranges(file, id, first, last) the mapping(file, pos, first, last, locator) with the longest overlap, then the first.

    Only the distinct ranges of a file meet, of equal ones in the mapping the first; their number is bounded by the
    file's lines, not by its rows.  Both sides are cut into cells of ``width`` lines, so the join is an equi-join on file
    and cell; a pair is looked at in the first cell that it shares.
    """
    cells = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    r = cells(ranges.select(file, "first", "last").distinct(), "first", "last")
    m = mapping.groupBy(file, F.col("first").alias("m_first"), F.col("last").alias("m_last")).agg(F.max(F.struct((-F.col("pos")).alias("p"), "locator")).alias("m"))
    both = r.join(cells(m, "m_first", "m_last"), [file, "cell"]).where((F.col("m_first") <= F.col("last")) & (F.col("first") <= F.col("m_last")) & (F.col("cell") == F.greatest(F.floor(F.col("first") / width), F.floor(F.col("m_first") / width))))
    overlap = F.least("last", "m_last") - F.greatest("first", "m_first") + 1
    best = both.groupBy(file, "first", "last").agg(F.max(F.struct(overlap.alias("overlap"), "m.p", "m.locator")).alias("b"))
    return ranges.join(best, [file, "first", "last"]).groupBy(file, "id").agg(F.max("b").alias("b")).select(file, "id", "b.locator", "b.overlap")


def entry_chunks(entries: DataFrame, chunks: DataFrame, file: str = "file_id", width: int = 64) -> DataFrame:
    """entries(file, entry, line) with the last chunk(file, idx, chunk_id, first, last) that covers the line, null if none.

    Only a file's distinct lines meet its distinct ranges, of equal ones the last chunk's.
    """
    c = chunks.groupBy(file, "first", "last").agg(F.max_by("chunk_id", "idx").alias("chunk_id"), F.max("idx").alias("idx"))
    c = c.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    lines = entries.select(file, "line").distinct().withColumn("cell", F.floor(F.col("line") / width))
    hits = lines.join(c, [file, "cell"]).where("line between first and last")
    return entries.join(hits.groupBy(file, "line").agg(F.max_by("chunk_id", "idx").alias("chunk_id")), [file, "line"], "left")
