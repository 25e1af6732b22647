import random

import pytest

import corpus_pipeline as C
from corpusq.llm import decontam, simhash, substring

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    word = lambda: rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") + rnd.choice("lmnrst") + rnd.choice(["", "a", "en", "ing"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    passage = text(60)
    docs, labels = [], []
    for i in range(120):
        t, bad = text(rnd.randrange(80, 160)), i % 5 == 4
        if bad:
            t = " ".join(w + rnd.choice(["$$$", "###", "%%%"]) for w in t.split())
        elif i % 10 == 1:
            t += " " + passage + " " + text(10)
        elif i % 10 == 3:
            t = text(40) + " " + items[i % 4][1] + " " + text(20)
        docs.append((i, t))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(200, docs[0][1]), (201, docs[5][1] + " extra"), (202, docs[6][1].upper()), (5, docs[5][1]), (203, text(90)), (204, None), (None, text(100))]
    at = tmp_path_factory.mktemp("tables")
    rows = [(d, t, "en", f"s{k % 4}", len(t or "")) for k, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages_do_their_work(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs, outputs = [], []
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(C.STAGES) - 1 or out.columns == NAMES, name
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append([(r.doc_id, r.text) for r in docs.collect()])
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outputs.append([(r.doc_id, r.text) for r in docs.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    bad = {i for i in range(120) if i % 5 == 4}
    assert {d for d, _ in inputs[0]} - {d for d, _ in outputs[0]} <= bad | {204} and not bad & {d for d, _ in outputs[0]}
    classes: dict = {}
    for (d, t), (_, f, c) in zip(inputs[1], simhash.brute(inputs[1])):
        classes.setdefault(c if c is not None else f, []).append((d, t))
    assert sorted(outputs[1], key=key) == sorted((min(v, key=key) for v in classes.values()), key=key)
    assert substring.brute(outputs[2]) == {} and substring.brute(inputs[2])
    first = min(d for d, t in inputs[2] if d is not None and d % 10 == 1 and d < 120)
    whole = dict(inputs[2])
    assert (first, whole[first]) in outputs[2]
    clean = [inputs[2][i] for i in set(range(len(inputs[2]))) - set(substring.brute(inputs[2]))]
    assert all(r in outputs[2] for r in clean)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = [r[-1] for r in decontam.brute(inputs[3], items)]
    assert any(dirty) and sorted(outputs[3], key=key) == sorted((r for r, x in zip(inputs[3], dirty) if not x), key=key)
    assert sorted(outputs[4], key=key) == sorted(inputs[4], key=key)
    last = docs.collect()
    by: dict = {}
    for r in last:
        assert 0 <= r.taken <= 3 * r.mix_size
        by.setdefault(r.source, []).append(r)
    assert all(abs(sum(r.taken for r in v) - v[0].target) <= 32 for v in by.values())


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert out.columns == [*NAMES, "mix_size", "source_size", "target", "taken"] and out.count() > 50
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == list(dict.fromkeys(n for n, _ in C.STAGES))


def test_clashing_columns_and_empty_tables(spark, folder, tmp_path):
    """Every stage keeps extra columns, whatever their names, as they are; the mix's own four replace theirs."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    extra = ["label", "score", "row", "doc", "uid", "fp", "k1", "at", "later", "size", "key", "taken", "Target", "mix_size", "a.b"]
    docs = read("documents").selectExpr("*", *[f"'{n}' as `{n}`" for n in extra])
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == NAMES + extra, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() and {tuple(r) for r in docs.selectExpr(*[f"`{n}`" for n in extra]).distinct().collect()} == {tuple(extra)}, name
    out = C.mix_stage(spark, docs, folder)
    assert out.columns == NAMES + extra[:-4] + ["a.b", "mix_size", "source_size", "target", "taken"] and out.count() == docs.count()
    none = tmp_path / "none"
    for n in ("documents", "labels", "benchmark"):
        read(n).limit(0).write.parquet(str(none / f"{n}.parquet"))
    assert C.run(spark, str(none)).count() == 0
    bare = tmp_path / "bare"
    read("documents").write.parquet(str(bare / "documents.parquet"))
    for n in ("labels", "benchmark"):
        read(n).limit(0).write.parquet(str(bare / f"{n}.parquet"))
    assert C.run(spark, str(bare)).count() > 50
