"""Documents made of pages: joining, markers, page maps, and which way a document is converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import lines
from corpusq.operators.lines import page_offsets

SEPARATOR = "\n\n---\n\n"


def to_markdown(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, markdown, mapping): the pages in order with rules between, and each page's lines."""
    at = page_offsets(pages, key, page, SEPARATOR.count("\n") - 1).withColumnRenamed(page, "__page")
    joined = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "content"))), lambda x: x["content"]), SEPARATOR).alias("markdown"))
    one = F.struct(F.col("first_line"), F.col("last_line"), F.concat(F.lit("page:"), F.col("__page").cast("string")).alias("locator"))
    return joined.join(at.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("mapping")), key)


#: Fixed value: how far apart in height two fragments of one line may stand.
LINE_GAP = 4.0


def assemble(fragments: DataFrame, *key: str, gap: float = LINE_GAP, by_x: bool = False) -> DataFrame:
    """(key, content): the lines of pages from positioned text, fragments(key, seq, x, y, text, eol) in the order of seq.

    A fragment begins a line if its height differs from the last known one before it by more than ``gap``, or if the one
    before ended a line.  White space counts as one space, NUL bytes as nothing; lines without text are left out, and the
    fragments of a line stand in their order, or with ``by_x`` from left to right.  A page's fragments meet in one task.
    """
    w = Window.partitionBy(*key).orderBy("seq")
    above = F.last("y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ended = F.coalesce(F.lag("eol").over(w), F.lit(False))
    begins = ended | F.coalesce(F.abs(F.col("y") - above) > gap, F.lit(False))
    text = F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\0"), F.lit("")), r"\s+", " "))
    rows = fragments.withColumns({"__begins": begins.cast("int"), "__text": text}).withColumn("__line", F.sum("__begins").over(w)).where("__text <> ''")
    order = F.struct(F.col("x") if by_x else F.lit(None).cast("double").alias("x"), "seq", "__text")
    lines_ = rows.groupBy(*key, "__line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda p: p["__text"]), " ").alias("t"))
    joined = lines_.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__line", "t"))), lambda p: p["t"]), "\n").alias("content"))
    return fragments.select(*key).distinct().join(joined, list(key), "left").select(*key, F.coalesce("content", F.lit("")).alias("content"))


def with_markers(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Like ``to_markdown``, with a marker line and a blank line before every page; mappings are moved along."""
    marked = pages.withColumn("content", F.concat(F.lit("<!-- page: "), F.col(page).cast("string"), F.lit(" -->\n\n"), F.col("content")))
    got = to_markdown(marked, key, page)
    return got.withColumn("mapping", F.transform("mapping", lambda m: F.struct((m["first_line"] + 2).alias("first_line"), m["last_line"].alias("last_line"), m["locator"].alias("locator"))))


def proportional(docs: DataFrame, key: str, n_lines: str, n_pages: str) -> DataFrame:
    """Pages as equal shares of a document's lines, where nothing better is known."""
    rows = docs.select(key, n_lines, n_pages, F.explode(F.sequence(F.lit(1), F.greatest(F.col(n_pages), F.lit(1)))).alias("page"))
    first = F.floor((F.col("page") - 1) * F.col(n_lines) / F.col(n_pages)) + 1
    last = F.floor(F.col("page") * F.col(n_lines) / F.col(n_pages))
    return rows.select(key, "page", first.alias("first_line"), F.greatest(first, last).alias("last_line"))


def page_ranges(markdown: str, pages: list[tuple[int, list[str]]], share: int = 20) -> list[tuple[int, int, int]]:
    """(page, first, last) of a document's pages, given as (page, texts) in order.

    A page goes from the first line at or after the end of the page before that holds its first text, to the next that
    holds its last.  A page without texts, or whose first text is not found, takes its share of the lines that are left.
    Without pages, every ``share`` lines are one.  Pages for which no line is left are not listed.
    """
    rows = (markdown or "").split("\n")
    total, at, out = len(rows), 1, []
    if not pages:
        size = -(-total // -(-total // share))
        return [(i + 1, a + 1, min(a + size, total)) for i, a in enumerate(range(0, total, size))]
    for i, (page, texts) in enumerate(pages):
        if at > total:
            break
        texts = [t for t in (x.strip() for x in texts or [] if x) if t]
        holds = lambda t, a: next((n for n in range(a, total + 1) if t in rows[n - 1]), None)
        first = holds(texts[0], at) if texts else None
        if first is None:
            first = at
            last = min(at + max(1, -(-(total - at + 1) // (len(pages) - i))) - 1, total)
        else:
            last = holds(texts[-1], first) or first
        out.append((page, first, last))
        at = last + 1
    return out


def locate(docs: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, page, first_line, last_line) of docs(key, markdown) by pages(key, page, texts): see ``page_ranges``.

    Where a page is looked for depends on the page before, so a document is one row of an Arrow batch.
    """
    spec = F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), F.col("texts").alias("texts"))))
    rows = docs.select(key, "markdown").join(pages.groupBy(key).agg(spec.alias("__pages")), key, "left")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [page_ranges(m, [(p["page"], p["texts"]) for p in ps or []]) for m, ps in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keys = b.column(0).take(pa.array([i for i, x in enumerate(got) for _ in x], pa.int64()))
            flat = [x for g in got for x in g]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([x[i] for x in flat], pa.int32()) for i in range(3)]], ["key", "page", "first_line", "last_line"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, page int, first_line int, last_line int").withColumnRenamed("key", key)


def merge_texts(direct: DataFrame, layout: DataFrame, key: str, page: str) -> DataFrame:
    """A page's own text, or where it has none the layout service's."""
    own = direct.select(key, page, F.nullif(F.trim("content"), F.lit("")).alias("__a"))
    other = layout.groupBy(key, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("__b"))
    return own.join(other, [key, page], "full_outer").select(key, page, F.coalesce("__a", "__b", F.lit("")).alias("content"))


def route(kind: Column, has_layout: bool) -> Column:
    """How a document of class text, scan or mixed is converted."""
    return F.when(kind == "text", "direct").when(kind == "scan", "layout" if has_layout else "error").otherwise("hybrid" if has_layout else "placeholder")
