import json
import pickle

import pytest
from pyspark.sql import functions as F

from corpusq import config
from corpusq.engine import Engine
from corpusq.operators import clues, fusion, tickets, tree
from corpusq.plans import providers as P
from corpusq.sources import metadata


def test_curated_trees_and_results(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.md").write_text("# Cats\n\ncats purr and sleep\n\n# Dogs\n\ndogs bark at cats\n")
    (root / "b.md").write_text("# Birds\n\nbirds sing\n")
    e = Engine(spark, str(tmp_path / "cat"), settings={"indexing": {"chunk_size": {"min_tokens": 1, "max_tokens": 8}}})
    e.index(str(root), "p")
    a = e.catalog.read("files").where("path = 'a.md'").first().file_id
    clue = e.clue_create("p", "Animals", "all of them")
    with pytest.raises(ValueError):
        e.clue_create("p", "Animals")
    e.clue_add(clue, "", "Mammals")
    e.clue_add(clue, "Mammals", "Cats", "leaf", file_id=a, seg_type="document")
    with pytest.raises(ValueError):
        e.clue_add(clue, "nowhere", "x")
    e.clue_update(clue, "Mammals", name="Beasts", summary="s")
    assert e.clue_tree(clue) == "Animals\n└── Beasts/\n    └── Cats"
    assert [(r.name, r.leaf_count) for r in e.clue_list("p").collect()] == [("Animals", 1)] and e.clue_list("q").isEmpty()
    got = {r.path: r for r in e.search_results("cats", keyword="cats").collect()}
    assert got["a.md"].clue_refs[0].leaf_path == "Beasts/Cats" and got["a.md"].clue_refs[0].clue_name == "Animals"
    assert [s.text for s in got["a.md"].snippets] and all("cats" in s.text.lower() for s in got["a.md"].snippets)
    assert "cats" in got["a.md"].content and got["a.md"].locator.startswith("line") and got["b.md"].clue_refs is None
    assert e.search_results("cats", profile="cloud").count() > 0
    e.clue_remove(clue, "Beasts/Cats")
    assert [r.path for r in e.clue_nodes(clue).collect()] == ["", "Beasts"]
    with pytest.raises(ValueError):
        e.clue_remove(clue, "Beasts/Cats")
    e.clue_delete(clue)
    assert e.clue_list().isEmpty() and e.catalog.read("clue_nodes").isEmpty()
    with pytest.raises(NotImplementedError):
        clues.delete(e.catalog.read("clues"), e.catalog.read("clue_nodes"), clue, "cloud")


class Counting:
    def __init__(self, path: str):
        self.path = path

    def embed(self, texts: list[str]) -> list[list[float]]:
        with open(self.path, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return [[1.0, float(len(t))] for t in texts]


def test_a_text_is_embedded_once(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name in "ab":
        (root / f"{name}.md").write_text("# Same\n\nthe same text\n")
    e = Engine(spark, str(tmp_path / "cat"), provider=Counting(f"{tmp_path}/asked"))
    assert e.index(str(root), "p") and e.catalog.read("chunks").where("size(content_vector) = 2").count() == 2
    assert len((tmp_path / "asked").read_text().splitlines()) == 1
    assert e.index(str(root), "p") is None and not (tmp_path / "cat" / "staging").exists()


def test_tickets_are_used_once_and_expire(spark):
    t = spark.createDataFrame([], "ticket_id string, user_id string, tenant_id string, role string, expires_at timestamp")
    t, key = tickets.issue(t, "u", "t", "admin")
    t, late = tickets.issue(t, "u", "t", "admin", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    row, rest = tickets.consume(t, key)
    assert row.first().asDict() == {"user_id": "u", "tenant_id": "t", "role": "admin"}
    assert tickets.consume(rest, key)[0].isEmpty() and tickets.consume(t, late)[0].isEmpty()
    assert t.count() == 2 and tickets.live(t).count() == 1


def test_retries_and_limits():
    assert [P.retry_delay(n) for n in range(3)] == [1000, 2000, 4000]
    assert [P.retry_delay(n, P.RateLimited()) for n in range(4)] == [30_000, 60_000, 120_000, 120_000]
    assert P.retry_delay(0, P.RateLimited("", 500)) == 500 and P.retry_delay(0, P.RateLimited("", 1e9)) == 120_000
    assert P.retry_after("2.5") == 2500 and P.retry_after(None) is P.retry_after("soon") is P.retry_after("-1") is None
    assert P.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4) == 6000
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = P.Limiter(2, 1500, lambda: now[0], sleep)
    calls = []

    def task():
        calls.append(now[0])
        if len(calls) < 3:
            raise P.RateLimited("", 4000) if len(calls) == 1 else OSError("down")
        return "ok"

    assert P.attempt(task, 3, limiter, sleep) == "ok" and calls == [0.0, 4.0, 6.0]
    with pytest.raises(OSError):
        P.attempt(lambda: (_ for _ in ()).throw(OSError()), 2, limiter, sleep)


def test_remote_provider_sends_a_text_once():
    sent = []

    def send(url, body, key):
        sent.append((url, body))
        if "input" in body:
            return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
        if "bad" in body["messages"][0]["content"]:
            raise ValueError("refused")
        return {"choices": [{"message": {"content": " short "}}]}

    r = P.Remote("http://x/", "m", retries=1, spacing=0, send=send)
    assert r.embed(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and r.embed(["bb"]) == [[2.0]] and len(sent) == 1
    assert r.summarise(["text", "", "bad", "text"]) == ["short", "", "", "short"] and len(sent) == 3
    r.send = P.post
    assert pickle.loads(pickle.dumps(r)).state is None
    c = P.Cache(2, 100)
    for k in "abc":
        c.put(k, [1.0])
    assert c.get("a") is None and c.get("c") == [1.0]
    assert P.token_prefix("x " * 10_000, 3000, lambda t: len(t.split())).count("x") == 3000
    assert P.token_prefix("short", 10, len) == "short"


def test_metadata_files(spark, tmp_path):
    file = {"file_id": "f1", "name": "n.md", "archive": "a1"}
    child = lambda name: {"name": name, "dir_id": name, "has_index": True}
    dirs = [("r", ".", [child("x"), child("gone")]), ("x", "x", [child("y")]), ("y", "x/y", []), ("lost", "z/q", [])]
    for i, (key, path, sub) in enumerate(dirs):
        at = tmp_path / "dirs" / str(i)
        at.mkdir(parents=True)
        (at / "index.json").write_text(json.dumps({"dir_id": key, "project_id": "p", "relative_path": path, "files": [file], "subdirectories": sub}, indent=1))
    got = metadata.directories(spark, f"{tmp_path}/dirs/*/index.json")
    walked = metadata.reachable(got)
    assert {r.dir_id for r in walked.collect()} == {"r", "x", "y"}
    assert {r.path for r in metadata.files(walked).collect()} == {"n.md", "x/n.md", "x/y/n.md"}
    assert [r.path for r in metadata.references(walked).collect()] == ["gone", "x", "x/y"]
    assert metadata.put(got, got.where("dir_id = 'x'").withColumn("summary", F.lit("new"))).where("summary = 'new'").count() == 1
    (tmp_path / "registry.json").write_text(json.dumps({"projects": [{"project_id": "p", "path": "/p", "valid": True}]}))
    assert metadata.registry(spark, f"{tmp_path}/registry.json").first().project_id == "p"
    log = metadata.StageLog(spark, f"{tmp_path}/log", "run")
    assert log.run("convert", "f1", lambda: 5) == 5
    with pytest.raises(KeyError):
        log.run("embed", "f1", lambda: {}["x"])
    log.flush()
    assert [(r.stage, r.status) for r in log.read().orderBy("stage").collect()] == [("convert", "done"), ("embed", "failed")]
    (tmp_path / "p").mkdir()
    for name in ("a.md", "b.bin"):
        (tmp_path / "p" / name).write_text("x")
    assert metadata.supported_files(spark, f"{tmp_path}/p", ["md"]) == 1


def test_scopes_and_options(spark):
    rows = [{"dir_id": "a", "parent_dir_id": None, "relative_path": "."}, {"dir_id": "b", "parent_dir_id": "a", "relative_path": "b"}, {"dir_id": "c", "parent_dir_id": "b", "relative_path": "b/c"}]
    assert tree.nest(rows, 1)[0]["subdirectories"] == [rows[1] | {"subdirectories": []}]
    scored = spark.createDataFrame([("a", 0.2), ("a", 0.9), ("b", 0.5), ("c", 0.1)], "chunk_id string, score double")
    assert [r.chunk_id for r in fusion.best_per_chunk(scored, 0.2, 5).collect()] == ["a", "b"]
    assert fusion.best_per_chunk(scored, 0, 9).count() == 3
    got = config.plugin_options({"text_extraction": {"enabled": True, "min_text_chars_per_page": 9.7}, "minerU": {"api_host": "h", "maxConcurrency": 0}, "converter": 3})
    assert got == {"text_extraction": {"enabled": True, "min_text_chars_per_page": 9}, "layout": {"server_url": "h", "max_concurrency": 4, "page_concurrency": 2, "crop_image_format": "png"}}
    assert config.plugin_options(None) == {}
    assert config.project_path("x", ["/one", "/two"], lambda p: p == "/two/x") == "/two/x" and config.project_path("x", ["/one"], lambda p: False) == "/one/x"
    assert config.archive_path("/r/", "a/b") == "/r/a/b/.index" and config.archive_path("/r", ".") == "/r/.index"
