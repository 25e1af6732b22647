import io
import zipfile

import pytest

from corpusq.engine import Engine
from corpusq.sources import files as S


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
    return out.getvalue()


def xlsx():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si><si><t>zebra</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>7</v></c></row><row r="3" hidden="1"><c r="B3" t="s"><v>1</v></c><c r="C3"><f>C2+1</f><v>8</v></c></row></sheetData><mergeCells><mergeCell ref="B2:B3"/></mergeCells></worksheet>')
    return out.getvalue()


def test_converters():
    text, mapping = S.from_docx(docx(("Heading 2", "Title"), ("Normal", "Words here")))
    assert text.split("\n") == ["## Title", "", "Words here", "", "| a\\|b |  |", "| --- | --- |"]
    assert [m[2] for m in mapping] == ["heading:Title", "para:1", "table:0"]
    text, mapping = S.from_xlsx(xlsx())
    assert text.split("\n") == ["## Data", "| name | 7 |", "| --- | --- |", "| zebra | 8 |"]
    assert mapping == [(2, 4, "Data!B2:C3")]
    cells = {(c["row"], c["col"]): c for c in S.xlsx_cells(xlsx())}
    assert cells[3, 3]["formula"] == "=C2+1" and cells[3, 3]["hidden_row"] and cells[2, 2]["is_merge_master"] and cells[3, 2]["merge_type"] == "vertical"
    assert S.paragraph_mapping("a\nb\n\nc") == [(1, 2, "line:1-2"), (4, 4, "line:4-4")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("secret")
    (root / "a.md").write_text("# Cats\n\ncats purr and sleep\n\n# Dogs\n\ndogs bark loudly")
    (root / "sub" / "b.txt").write_text("zebras graze\nin the savanna")
    (root / "sub" / "c.docx").write_bytes(docx(("Normal", "A whale swims")))
    (root / "sub" / "d.xlsx").write_bytes(xlsx())
    (root / "sub" / "bad.docx").write_bytes(b"no zip")
    (root / "z.bin").write_bytes(b"\0")
    return root


def test_index_search_and_tools(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "cat"), settings={"indexing": {"chunk_size": {"min_tokens": 1, "max_tokens": 8}}})
    assert e.index(str(folder), "p1")
    files = {r.path: r for r in e.catalog.read("files").collect()}
    assert set(files) == {"a.md", "sub/b.txt", "sub/c.docx", "sub/d.xlsx", "sub/bad.docx"}
    assert files["sub/bad.docx"].status == "failed" and files["sub/bad.docx"].error_message
    hit = e.search("zebras graze", keyword="zebras").first()
    assert hit.file_id == files["sub/b.txt"].file_id and "zebras" in hit.content
    assert e.search("dogs bark", paths=["sub"]).where(f"file_id = '{files['a.md'].file_id}'").isEmpty()
    assert [r.line_no for r in e.grep("SWIMS").collect()] == [1]
    assert [r.path for r in e.glob("**/*.docx").collect()] == ["sub/bad.docx", "sub/c.docx"]
    assert e.read("a.md", 3, 3).first().content == "cats purr and sleep"
    assert e.get_chunk(files["a.md"].file_id + ":0001", 1).count() == 2
    assert [(r.level, r.relative_path, r.file_count) for r in e.tree().collect()] == [(0, ".", 5), (1, "sub", 4)]
    assert e.search("whale swims", profile="cloud", top_k=1).count() == 1
    (folder / "sub" / "b.txt").write_text("lions roar")
    (folder / "sub" / "d.xlsx").unlink()
    before = {r.chunk_id for r in e.catalog.read("chunks").collect()}
    assert e.index(str(folder), "p1")
    after = e.catalog.read("chunks")
    assert after.where("content like '%lions%'").count() == 1 and after.where("content like '%zebra%'").isEmpty()
    assert {c for c in before if c.startswith(files["a.md"].file_id)} <= {r.chunk_id for r in after.collect()}
    assert e.keyword_search("zebras").isEmpty()
    e.purge(["sub"])
    assert [r.path for r in e.catalog.read("files").collect()] == ["a.md"]
    assert "chunks" in e.views()
    assert spark.sql("select count(distinct file_id) n from postings").first().n == 1


def test_tenants_see_only_their_rows(spark, folder, tmp_path):
    one, two = (Engine(spark, str(tmp_path / "t"), tenant=t) for t in ("one", "two"))
    one.index(str(folder), "p1")
    two.index(str(folder), "p2")
    a, b = ({r.file_id for r in e.catalog.read("files").collect()} for e in (one, two))
    assert a and b and not a & b
    assert one.search("dogs").count() > 0
