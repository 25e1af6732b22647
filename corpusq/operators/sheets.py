"""Spreadsheet analysis on cells(sheet, row, col, value, formula, dtype, merge_type, is_merge_master, bg, border).

Bounds, types, differences, sizes and overviews are aggregations over all cells; regions and tables are connected
components within one sheet, found in numpy for many whole sheets at once (a sheet is bounded by its file format).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL, GAIN = 400, 0.1


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number(text: str) -> int:
    out = 0
    for ch in text.upper():
        out = out * 26 + ord(ch) - 64
    return out


def a1(top: int, left: int, bottom: int, right: int) -> str:
    first, last = f"{letters(left)}{top}", f"{letters(right)}{bottom}"
    return first if first == last else f"{first}:{last}"


def parse_a1(text: str) -> tuple[int, int, int, int]:
    import re

    m = re.fullmatch(r"(?:.*!)?\$?([A-Za-z]+)\$?(\d+)(?::\$?([A-Za-z]+)\$?(\d+))?", text.strip())
    if not m:
        raise ValueError(f"not a cell range: {text}")
    top, left = int(m[2]), number(m[1])
    return top, left, int(m[4] or m[2]), number(m[3] or m[1])


def filled(prefix: str = "") -> Column:
    return (F.trim(F.coalesce(F.col(f"{prefix}value"), F.lit(""))) != "") | F.coalesce(F.col(f"{prefix}formula") != "", F.lit(False))


def bounds(cells: DataFrame) -> DataFrame:
    """First and last row and column with content of every sheet; A1 where there is none."""
    has = filled()
    edge = lambda f, c, d: F.coalesce(f(F.when(has, F.col(c))), F.lit(d)).cast("int")
    return cells.groupBy("sheet").agg(edge(F.min, "row", 1).alias("top"), edge(F.min, "col", 1).alias("left"), edge(F.max, "row", 1).alias("bottom"), edge(F.max, "col", 1).alias("right"))


def dtype(value: Column, formula: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(F.coalesce(formula, F.lit("")) != "", "Formula").when(v == "", "Empty").when(v.rlike("^#(N/A|REF!|VALUE!|DIV/0!|NAME\\?|NUM!|NULL!)$"), "Error")
        .when(F.lower(v).isin("true", "false"), "Boolean").when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"), "Date").when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "Number").otherwise("Text")
    )


def type_differences(cells: DataFrame, axis: str = "row", rule: str = "mean", least: float = 0.8) -> DataFrame:
    """Rows (or columns) whose cells differ in type from the cell before in a share of at least ``least``.

    ``mean``: the share over the cells; ``any``: 1 if one cell differs.
    """
    across = "col" if axis == "row" else "row"
    w = Window.partitionBy("sheet", across).orderBy(axis)
    rows = cells.withColumn("before", F.lag("dtype").over(w)).where("before is not null")
    differs = (F.col("dtype") != F.col("before")).cast("double")
    return rows.groupBy("sheet", axis).agg((F.max if rule == "any" else F.avg)(differs).alias("ratio")).where(F.col("ratio") >= least)


REGION = ["sheet", "top", "left", "bottom", "right"]


def _kept(cells: DataFrame, found: DataFrame, axis: str, rule: str, least: float) -> DataFrame:
    """(region, kept): the lines of every region whose types differ from the line before, in order.

    Cells without a row are empty.  So a line differs at a cell whose neighbour before is empty or of another type, and
    after a cell that nothing follows.
    """
    across, first, last = ("col", "top", "bottom") if axis == "row" else ("row", "left", "right")
    w = Window.partitionBy(*REGION, across).orderBy(axis)
    near = cells.withColumns({"__p": F.lag(F.struct(axis, "dtype")).over(w), "__n": F.lead(axis).over(w)})
    at = F.col(axis)
    own = (at > F.col(first)) & ~F.coalesce((F.col(f"__p.{axis}") == at - 1) & (F.col("__p.dtype") == F.col("dtype")), F.lit(False))
    after = (at < F.col(last)) & F.coalesce(F.col("__n") > at + 1, F.lit(True))
    both = F.filter(F.array(F.when(own, at), F.when(after, at + 1)), lambda x: x.isNotNull())
    n = near.select(*REGION, F.explode(both).alias("line")).groupBy(*REGION, "line").agg(F.count("*").alias("n"))
    width = (F.col("right") - F.col("left") if axis == "row" else F.col("bottom") - F.col("top")) + 1
    ratio = F.lit(1.0) if rule == "any" else F.col("n") / width
    if least <= 0:
        return found.select(*REGION, F.sequence(first, last).alias("kept"))
    return n.where(ratio >= least).groupBy(*REGION).agg(F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("kept"))


def compression_plans(cells: DataFrame, found: DataFrame, rule: str = "any", least: float = 0.8) -> DataFrame:
    """How every region(sheet, top, left, bottom, right) is written: mode ``row``, ``column`` or ``none``, the kept lines, the ratio saved.

    A line is kept if its cells(sheet, row, col, dtype) differ in type from the line before in a share of ``least``; by the
    rule ``any`` one such cell is enough.  The axis that loses the greater share of its lines is taken if that is over
    10 %; ties and regions below 400 cells are ``none``, which keeps all lines (kept is null).
    """
    inside = cells.where("dtype <> 'Empty'").join(found.select(*REGION).distinct(), "sheet").where("row between top and bottom and col between left and right")
    found = found.select(*REGION).distinct()
    rows = _kept(inside, found, "row", rule, least).withColumnRenamed("kept", "__r")
    cols = _kept(inside, found, "col", rule, least).withColumnRenamed("kept", "__c")
    height, width = F.col("bottom") - F.col("top") + 1, F.col("right") - F.col("left") + 1
    out = found.join(rows, REGION, "left").join(cols, REGION, "left")
    none = F.array().cast("array<int>")
    out = out.withColumns({"__r": F.coalesce("__r", none), "__c": F.coalesce("__c", none)})
    by_row, by_col = 1 - F.size("__r") / height, 1 - F.size("__c") / width
    mode = F.when(height * width < SMALL, "none").when((by_row > by_col) & (by_row > GAIN), "row").when((by_col > by_row) & (by_col > GAIN), "column").otherwise("none")
    out = out.withColumn("mode", mode)
    pick = lambda a, b, c: F.when(F.col("mode") == "row", a).when(F.col("mode") == "column", b).otherwise(c)
    return out.select(*REGION, "mode", pick(F.col("__r"), F.col("__c"), F.lit(None)).alias("kept"), pick(by_row, by_col, F.lit(0.0)).alias("ratio"))


def overview(cells: DataFrame) -> DataFrame:
    """One text per sheet: a line per row, cells apart by |, ``<`` and ``^`` for cells merged into the left or upper one, formulas, (H) for hidden rows."""
    text = F.regexp_replace(F.coalesce("value", F.lit("")), r"\s*[\r\n]+\s*", " ")
    text = F.replace(text, F.lit("|"), F.lit("\\|"))
    text = F.when(F.coalesce("formula", F.lit("")) != "", F.concat(text, F.lit(" ["), F.col("formula"), F.lit("]"))).otherwise(text)
    mark = F.when(F.col("is_merge_master") | (F.col("merge_type") == "none"), text).when(F.col("merge_type") == "vertical", "^").otherwise("<")
    rows = cells.groupBy("sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", mark.alias("t")))), lambda x: x["t"]), " | ").alias("line"), F.max("hidden_row").alias("hidden"))
    line = F.concat(F.col("row").cast("string"), F.when(F.col("hidden"), " (H)").otherwise(""), F.lit(": "), F.col("line"))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))), lambda x: x["t"]), "\n").alias("overview"))


def markdown_table(cells: DataFrame, header: int = 1) -> DataFrame:
    """cells as a Markdown table per sheet, the first rows being the header."""
    clean = F.replace(F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    rows = cells.groupBy("sheet", "row").agg(F.count("*").alias("n"), F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", clean.alias("t")))), lambda x: x["t"]), " | "), F.lit(" |")).alias("line"))
    rule = F.concat(F.col("line"), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n").cast("int")))
    w = Window.partitionBy("sheet").orderBy("row")
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("line", F.when(F.col("i") == header, rule).otherwise(F.col("line")))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def split_regions(points: set[tuple[int, int]], gap: int = 2, joined=lambda axis, edge: False) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (top, left, bottom, right): cut where ``gap`` or more rows or columns are empty, again and again.

    joined(axis, edge) says that borders connect what lies on either side of a gap.
    """
    if not points:
        return []
    box = (min(r for r, _ in points), min(c for _, c in points), max(r for r, _ in points), max(c for _, c in points))
    for axis in (0, 1):
        used = sorted({p[axis] for p in points})
        for a, b in zip(used, used[1:]):
            if b - a > gap and not joined(axis, (a, b)):
                left = {p for p in points if p[axis] <= a}
                return split_regions(left, gap, joined) + split_regions(points - left, gap, joined)
    return [box]


def components(points: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Bounding boxes of 4-connected groups with more than one row and column."""
    left, out = set(points), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            r, c = todo.pop()
            seen.append((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        box = (min(r for r, _ in seen), min(c for _, c in seen), max(r for r, _ in seen), max(c for _, c in seen))
        if box[2] > box[0] and box[3] > box[1]:
            out.append(box)
    return sorted(out)


def gap_parts(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, gap: int = 2) -> np.ndarray:
    """The part, from 0, of every point: ``split_regions`` for all sheets (numbered from 0) at once.

    A gap of some points is one of any subset on both its sides, so all cuts of an axis can be made together.
    """
    part = sheet
    while True:
        n = part.max() + 1
        for x in (row, col):
            order = np.lexsort((x, part))
            p, y = part[order], x[order]
            new = np.append(False, (p[1:] != p[:-1]) | (y[1:] - y[:-1] > gap))
            part = np.empty_like(p)
            part[order] = np.cumsum(new)
        if part.max() + 1 == n:
            return part


def grid_parts(sheet: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The 4-connected group of every point, as the number of one of its runs of columns: ``components`` for all sheets at once."""
    order = np.lexsort((col, row, sheet))
    s, r, c = sheet[order], row[order], col[order]
    # A point that occurs again stays in the run.
    run = np.empty(len(s), np.int64)
    run[order] = np.cumsum(np.append(False, (s[1:] != s[:-1]) | (r[1:] != r[:-1]) | (c[1:] - c[:-1] > 1)))
    order = np.lexsort((row, col, sheet))
    s, r, c = sheet[order], row[order], col[order]
    near = np.flatnonzero((s[1:] == s[:-1]) & (c[1:] == c[:-1]) & (r[1:] - r[:-1] == 1))
    a, b = run[order][near], run[order][near + 1]
    group = np.arange(run.max() + 1)
    while True:
        x, y = group[a], group[b]
        if (x == y).all():
            return group[run]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while ((up := group[group]) != group).any():
            group = up


def _whole_sheets(batches: Iterator) -> Iterator:
    """Tables of whole sheets, from batches that are sorted by sheet."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        last = b.column(0)[b.num_rows - 1]
        n = pc.index(b.column(0), last).as_py() if last.is_valid else 0
        if held and (n or held[0].column(0)[0].as_py() != last.as_py()) or n:
            yield pa.Table.from_batches([*held, b.slice(0, n)])
            held = []
        held.append(b.slice(n))
    if held:
        yield pa.Table.from_batches(held)


def _boxes(parts: Callable, cells: DataFrame, least: int = 0) -> DataFrame:
    """The distinct bounding boxes of the parts of the points cells(sheet, row, col, kind), longer than ``least`` both ways.

    parts gives each point's part from the numbers of sheet and kind, row and column.  Sheets are kept together by one
    shuffle; a task works on as many whole ones as a batch holds.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in _whole_sheets(batches):
            sheets, kinds = (t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("sheet", "kind"))
            sheet, kind = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sheets, kinds))
            row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
            part = parts(sheet * len(kinds.dictionary) + kind, row, col)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            low, high = (lambda x: np.minimum.reduceat(x[order], at)), (lambda x: np.maximum.reduceat(x[order], at))
            box = np.stack([sheet[order][at], low(row), low(col), high(row), high(col)])
            box = box[:, (box[3] - box[1] >= least) & (box[4] - box[2] >= least)]
            box = box[:, np.lexsort(box[::-1])]
            box = box[:, np.append(True, (np.diff(box) != 0).any(axis=0))[: box.shape[1]]]
            # Few shapes make up most boxes, so each is written as a range once.
            shapes, which = np.unique(box[1:], axis=1, return_inverse=True)
            names = pa.array([a1(*x) for x in shapes.T.tolist()], pa.string()).take(pa.array(which.ravel()))
            yield pa.RecordBatch.from_arrays([sheets.dictionary.take(pa.array(box[0])), names, *[pa.array(x, pa.int32()) for x in box[1:]]], ["sheet", "range", "top", "left", "bottom", "right"])

    rows = cells.select(F.col("sheet").cast("string").alias("sheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "kind")
    return rows.repartition("sheet").sortWithinPartitions("sheet").mapInArrow(run, "sheet string, range string, top int, left int, bottom int, right int")


def regions(cells: DataFrame, gap: int = 2) -> DataFrame:
    """Regions of content apart by ``gap`` empty rows or columns; bordered empty cells count as content."""
    has = cells.where(filled() | F.coalesce("bordered", F.lit(False)))
    return _boxes(lambda sheet, row, col: gap_parts(sheet, row, col, gap), has.withColumn("kind", F.lit("")))


def tables(cells: DataFrame) -> DataFrame:
    """Tables: connected bordered cells, and connected cells of one background, more than one row and column each."""
    line, bg = F.coalesce("bordered", F.lit(False)), F.coalesce("bg", F.lit(""))
    return _boxes(grid_parts, cells.where(line | (bg != "")).withColumn("kind", F.when(line, "").otherwise(bg)), 1)


def searchable(found: DataFrame, cells: DataFrame) -> DataFrame:
    """One entry per distinct range(sheet, range, top, left, bottom, right): its cells' text in reading order."""
    from corpusq.functions.text import search_text

    inside = cells.where(filled()).join(found.distinct(), "sheet").where("row between top and bottom and col between left and right")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", search_text(F.col("value")).alias("t")))), lambda x: x["t"]), " ")
    return inside.groupBy("sheet", "range").agg(text.alias("text")).withColumn("locator", F.concat_ws("!", "sheet", "range"))
