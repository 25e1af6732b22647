"""Directory scans and converters: files to Markdown with source positions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import extension, parent_path
from corpusq.operators.sheets import a1, parse_a1

RESULT = "path string, markdown string, mapping array<struct<start_line:int,end_line:int,locator:string>>, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def scan(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """Files below root without dot names: path, relative_path, dir, size, modified, supported."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_extract("path", re.escape(base) + r"/(.*)$", 1), "%20", " ")
    rows = raw.select("path", rel.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(~F.col("relative_path").rlike(r"(^|/)\."))
    return rows.withColumns({"dir": parent_path(F.col("relative_path")), "supported": extension(F.col("relative_path")).isin(*[e.lower().lstrip(".") for e in extensions])})


def paragraph_mapping(markdown: str) -> list[tuple[int, int, str]]:
    """Runs of non-blank lines as (first, last, ``line:first-last``)."""
    out, start = [], None
    for i, line in enumerate([*markdown.split("\n"), ""], 1):
        if line.strip() and start is None:
            start = i
        elif not line.strip() and start is not None:
            out.append((start, i - 1, f"line:{start}-{i - 1}"))
            start = None
    return out


def from_markdown(data: bytes) -> tuple[str, list]:
    text = data.decode("utf-8", "replace")
    return text, paragraph_mapping(text)


def clean_cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().replace("|", "\\|")


def table(rows: list[list[str]]) -> list[str]:
    """A Markdown table; short rows are filled up."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*map(clean_cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return [*lines[:1], "|" + " --- |" * width, *lines[1:]] if width else []


def from_docx(data: bytes) -> tuple[str, list]:
    """Headings, paragraphs, tables and image places of a Word document, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    lines: list[str] = []
    mapping: list[tuple[int, int, str]] = []
    para = tables = 0

    def words(node) -> str:
        parts = []
        for x in node.iter():
            if x.tag == f"{W}t":
                parts.append(x.text or "")
            elif x.tag == f"{W}tab":
                parts.append("\t")
            elif x.tag == f"{W}br":
                parts.append("\n")
            elif x.tag.endswith("}blip"):
                parts.append("[image]")
        return "".join(parts).strip()

    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            text = words(node)
            style = node.find(f"{W}pPr/{W}pStyle")
            m = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{W}val", "") if style is not None else "")
            if text:
                block = [f"{'#' * int(m[1])} {text}"] if m else text.split("\n")
                mapping.append((len(lines) + 1, len(lines) + len(block), f"heading:{text}" if m else f"para:{para}"))
                lines += [*block, ""]
            para += 1
        elif node.tag == f"{W}tbl":
            block = table([[words(c) for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")])
            if block:
                mapping.append((len(lines) + 1, len(lines) + len(block), f"table:{tables}"))
                lines += [*block, ""]
            tables += 1
    return "\n".join(lines).rstrip("\n"), mapping


def xlsx_cells(data: bytes) -> Iterator[dict]:
    """Cells of a workbook with their formulas, merges and hidden rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.iter(f"{S}sheet"):
            rid = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = rels[rid].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            merged = {}
            for m in root.iter(f"{S}mergeCell"):
                top, left, bottom, right = parse_a1(m.get("ref"))
                for r in range(top, bottom + 1):
                    for c in range(left, right + 1):
                        kind = "vertical" if c == left else "horizontal" if r == top else "both"
                        merged[r, c] = (kind if (r, c) != (top, left) else "both", (r, c) == (top, left))
            for row in root.iter(f"{S}row"):
                for c in row.findall(f"{S}c"):
                    top, left, _, _ = parse_a1(c.get("r"))
                    v, f = c.find(f"{S}v"), c.find(f"{S}f")
                    value = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else v.text if v is not None else ""
                    value = shared[int(value)] if c.get("t") == "s" and value else value
                    kind, master = merged.get((top, left), ("none", False))
                    yield {"sheet": sheet.get("name"), "row": top, "col": left, "value": value or "", "formula": f"={f.text}" if f is not None and f.text else "", "merge_type": kind, "is_merge_master": master, "hidden_row": row.get("hidden") == "1"}


def from_xlsx(data: bytes) -> tuple[str, list]:
    """Every sheet's used range as a heading and a table."""
    sheets: dict[str, dict] = {}
    for c in xlsx_cells(data):
        if c["value"].strip() or c["formula"]:
            sheets.setdefault(c["sheet"], {})[c["row"], c["col"]] = c["value"] or c["formula"]
    lines: list[str] = []
    mapping: list[tuple[int, int, str]] = []
    for name, cells in sheets.items():
        rows, cols = [r for r, _ in cells], [c for _, c in cells]
        box = (min(rows), min(cols), max(rows), max(cols))
        block = table([[cells.get((r, c), "") for c in range(box[1], box[3] + 1)] for r in range(box[0], box[2] + 1)])
        lines.append(f"## {name}")
        mapping.append((len(lines) + 1, len(lines) + len(block), f"{name}!{a1(*box)}"))
        lines += [*block, ""]
    return "\n".join(lines).rstrip("\n"), mapping


class Converters:
    """Converters by extension; a later registration replaces an earlier one."""

    def __init__(self):
        self.by: dict[str, Callable[[bytes], tuple[str, list]]] = {}
        for names, f in ((("md", "markdown", "txt"), from_markdown), (("docx",), from_docx), (("xlsx",), from_xlsx)):
            self.register(names, f)

    def register(self, extensions, convert: Callable[[bytes], tuple[str, list]]) -> None:
        for e in extensions:
            self.by[e.lower().lstrip(".")] = convert

    def supports(self, path: str) -> bool:
        return path.rpartition(".")[2].lower() in self.by

    def convert(self, files: DataFrame) -> DataFrame:
        """files(path, content binary) to Markdown; a file that can't be read gives a row with an error."""
        by = dict(self.by)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                rows = []
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    f = by.get(path.rpartition(".")[2].lower())
                    try:
                        text, mapping = f(data or b"") if f else ("", [])
                        error = None if f else "unsupported"
                    except Exception as e:
                        text, mapping, error = "", [], str(e)[:500]
                    rows.append({"path": path, "markdown": text, "mapping": [{"start_line": a, "end_line": b, "locator": x} for a, b, x in mapping], "error": error})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("markdown", pa.string()), ("mapping", pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("locator", pa.string())]))), ("error", pa.string())]))

        return files.select("path", "content").mapInArrow(run, RESULT)


def read_cells(files: DataFrame) -> DataFrame:
    """files(path, content binary) of workbooks to cells."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("formula", pa.string()), ("merge_type", pa.string()), ("is_merge_master", pa.bool_()), ("hidden_row", pa.bool_())])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"path": path, **c} for c in xlsx_cells(data)]
                for a in range(0, len(rows), 10000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 10000], schema)

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, col int, value string, formula string, merge_type string, is_merge_master boolean, hidden_row boolean")
