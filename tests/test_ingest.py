"""URLs and ready rows into the catalog, resumed index runs, segmented search through the engine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusq.engine import Engine
from corpusq.operators import changes
from corpusq.plans import indexing
from corpusq.sources import urls
from corpusq.sources.files import Converters

SMALL = {"indexing": {"chunk_size": {"min_tokens": 1, "max_tokens": 20}}}


class Site(BaseHTTPRequestHandler):
    pages = {"/a.md": b"# Zebras\n\nzebras graze in herds", "/plain": b"whales sing far away", "/large": b"x" * 5000, "/report.docx": b"no zip"}

    def do_GET(self):
        if self.path in ("/hop1", "/hop2"):
            self.send_response(302)
            self.send_header("Location", "/hop2" if self.path == "/hop1" else "/a.md")
            self.end_headers()
        elif self.path in ("/loop", "/inside"):
            self.send_response(301)
            self.send_header("Location", "/loop" if self.path == "/loop" else "http://169.254.169.254/secret")
            self.end_headers()
        elif self.path in self.pages:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.pages[self.path])
        else:
            self.send_error(404)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def fetched(spark, site, *paths, **options):
    spark.dataSource.register(urls.Urls)
    read = spark.read.format("urls").option("urls", json.dumps([p if "://" in p else site + p for p in paths])).option("allow", '["127.0.0.1"]').option("perTask", 2)
    for k, v in options.items():
        read = read.option(k, v)
    return read.load()


def test_every_url_gives_a_row(spark, site):
    df = fetched(spark, site, "/a.md", "/hop1", "/plain", "/large", "/loop", "/inside", "/none", "file:///etc/passwd", "http://localhost:1/x", "http://10.0.0.1/x", "http://[::1]/x", "/a.md", most=1000)
    assert df.rdd.getNumPartitions() == 6
    got = {r.url.removeprefix(site): r for r in df.collect()}
    assert len(got) == 11 and got["/a.md"].content == got["/hop1"].content == Site.pages["/a.md"] and got["/hop1"].final_url == site + "/a.md"
    assert {k: r.error for k, r in got.items() if r.error} == {"/large": "too large", "/loop": "too many redirects", "/inside": "this host is not allowed", "/none": "status 404", "file:///etc/passwd": "this address is not allowed"} | dict.fromkeys(["http://localhost:1/x", "http://10.0.0.1/x", "http://[::1]/x"], "this host is not allowed")
    assert fetched(spark, site).count() == 0
    with pytest.raises(urls.Refused):
        urls.check("http://127.1/")
    assert fetched(spark, site, "/hop1", redirects=1).first().error == "too many redirects"


def test_urls_become_files(spark, site, tmp_path):
    e = Engine(spark, str(tmp_path / "c"), settings=SMALL)
    assert e.ingest(fetched(spark, site, "/a.md", "/plain", "/none", "/report.docx"), "p")
    files = {r.name.partition("-")[0]: r for r in e.catalog.read("files").collect()}
    assert {n: (r.status, r.type) for n, r in files.items()} == {"a": ("indexed", "md"), "plain": ("indexed", "txt"), "none": ("failed", "txt"), "report": ("failed", "docx")}
    assert files["none"].error_message == "status 404" and files["a"].path.startswith("urls/a-")
    assert e.keyword_search("zebras").first().file_id == files["a"].file_id and e.keyword_search("whales").first().file_id == files["plain"].file_id
    e.ingest(fetched(spark, site, "/a.md"), "p", "urls")
    assert e.catalog.read("files").count() == 4 and e.catalog.read("chunks").where(F.col("file_id") == files["a"].file_id).count() == e.catalog.read("chunks").where(F.col("file_id") == files["a"].file_id).distinct().count() == 1


def test_ready_rows_are_imported(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "c"), settings=SMALL)
    schema = "path string, idx int, content string, locator string, line_start int, line_end int, content_vector array<float>, hash string"
    row = lambda path, i, text, v=True: (path, i, text, f"lines:{i}-{i}", i, i, [1.0, 0.0] if v else None, "h")
    indexing.import_rows(e.catalog, "p", spark.createDataFrame([row("d/a.md", 0, "old words"), row("d/a.md", 1, "more"), row("b.md", 0, "bears", False)], schema))
    indexing.import_rows(e.catalog, "p", spark.createDataFrame([row("d/a.md", 0, "new words")], schema))
    files = {r.path: r for r in e.catalog.read("files").collect()}
    assert {p: (r.status, r.chunk_count) for p, r in files.items()} == {"d/a.md": ("indexed", 1), "b.md": ("embedding", 1)}
    assert e.keyword_search("new").first().file_id == files["d/a.md"].file_id and e.keyword_search("old").isEmpty()
    assert {r.relative_path: r.file_count for r in e.catalog.read("directories").collect()} == {".": 2, "d": 1}
    assert changes.compact(e.catalog.read("chunks")).count() == 2


class Counting(indexing.HashingEmbedder):
    """Writes down every text that it is asked for."""

    def __init__(self, log):
        super().__init__(8)
        self.log = str(log)

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.writelines("embed\n" for _ in texts)
        return super().embed(texts)


def test_a_stopped_run_is_taken_up(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "files", tmp_path / "log"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.md").write_text(f"# Title {i}\n\nword{i}")

    def convert(data, log=str(log)):
        with open(log, "a") as f:
            f.write("convert\n")
        return data.decode(), []

    converters = Converters()
    converters.register(["md"], convert)
    e = Engine(spark, str(tmp_path / "c"), settings=SMALL, provider=Counting(log))
    run = lambda: indexing.index(e.catalog, str(root), "p", converters, e.provider, 1, 20)

    def dies(**_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(e.catalog, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            run()
    e.catalog.held = []  # the run's process is gone
    (root / "1.md").write_text("# Title 1\n\nchanged")
    (root / "4.md").write_text("# Title 4\n\nnew")
    (root / "3.md").unlink()
    before = log.read_text().split()
    assert before.count("convert") == 4 and before.count("embed") == 4
    assert run()
    after = log.read_text().split()
    assert after.count("convert") == 6 and after.count("embed") == 6
    assert {r.path for r in e.catalog.read("files").collect()} == {"0.md", "1.md", "2.md", "4.md"}
    assert e.keyword_search("changed").count() == e.keyword_search("word0").count() == 1 and e.keyword_search("word1").isEmpty()
    # What was taken over is released with the run; a dead run's list of changes stays, as it could be another run's.
    assert run() is None and {p.parts[-3] for p in (tmp_path / "c" / "staging").rglob("*.parquet")} == {"rows"}


def test_segmented_search(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for i, words in enumerate(["天地玄黄", "宇宙洪荒", "天地宇宙", "玄黄洪荒", "洪荒天地", "宇宙玄黄"] * 3):
        (root / f"{i}.md").write_text(f"{words}{words[2:]}{words[:2]}。Spark{i}")
    e = Engine(spark, str(tmp_path / "c"), settings=SMALL | {"indexing": SMALL["indexing"] | {"segment": True}})
    e.index(str(root), "p")
    words = {r.word for r in e.catalog.read("lexicon").collect()}
    assert {"天", "地"} < words
    assert e.terms("天地Spark3") == e.terms("天地") + ["spark3"]
    assert e.keyword_search("Spark3").count() == 1 and e.keyword_search("天地").count() == 9
    (root / "new.md").write_text("天地")
    before = {tuple(r) for r in e.catalog.read("lexicon").collect()}
    e.index(str(root), "p")
    assert {tuple(r) for r in e.catalog.read("lexicon").collect()} == before and e.keyword_search("天地").count() == 10
