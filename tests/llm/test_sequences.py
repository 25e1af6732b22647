"""op11: ids, places and files against the tokenizers library over whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import sequences as S

tokenizers = pytest.importorskip("tokenizers")
pa = pytest.importorskip("pyarrow")


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(S.VOCABULARY)
    return lambda text: np.array(own.encode(text or "", add_special_tokens=False).ids + [S.END], "<u4")


def texts():
    rnd = random.Random(5)
    bits = ["the ", "Token", "\n", "don't ", "É", "é ", " ́x", "中文 ", "Σ", "ΑΣ ", "😀", "\x1c", "\x85", " ", " ", "\x00", "12345", "<|endoftext|>", "<|", "!!", "'s", "'S", "_", "ﬁ", "İ", "\t\x0b\x0c\r", "Straße", "١٢"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(300)] + ["", " ", None, "word " * 3, "a" * 100]


def test_words_are_encoded_as_whole_texts(library, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 16)
    monkeypatch.setattr(S, "MEMO", 50)
    S.encoder.cache_clear()
    with open(S.VOCABULARY, encoding="utf-8") as f:
        encode = S.encoder(f.read())
    for t in texts() * 2:
        assert (np.frombuffer(encode((t or '').encode()), "<u4") == library(t)[:-1]).all(), t
    S.encoder.cache_clear()


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library(text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length,rows", [(8, 3), (1, 1), (1024, 64)])
def test_files_hold_all_documents(spark, tmp_path, library, length, rows):
    data = [(i * 7 % 311 - 20, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "h": F.lit(1), "r": F.lit(2), "start": F.lit(3)}).repartition(7)
    folder = f"file:{tmp_path}/out"
    S.write(df, folder, length=length, rows=rows, shards=3)
    got = sorted((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in S.documents(spark, folder).collect())
    assert got == expected(data, library)
    all_ids = np.concatenate([library(t) for _, t in sorted(data)])
    s = S.Sequences(folder)
    parts = [(ids, mask.to_numpy(zero_copy_only=False)) for ids, mask in (s[i] for i in range(len(s)))]
    assert all(len(ids) == len(mask) == length for ids, mask in parts)
    assert (np.concatenate([ids[mask] for ids, mask in parts]) == all_ids).all()
    shards = S.manifest(folder)["shards"]
    assert len(shards) == 3 and len(s) == sum(-(-x["tokens"] // length) for x in shards)
    rows_ = sorted(S.sequences(spark, folder).collect())
    assert [r.sequence for r in rows_] == list(range(len(s)))
    assert all(r.ids == ids.astype('<u4').tobytes() and r.mask == mask.tobytes() for r, (ids, mask) in zip(rows_, parts))
    with pytest.raises(IndexError):
        s[len(s)]


def test_files_are_plain_arrow_streams(spark, tmp_path):
    S.write(spark.createDataFrame([(i, "some words here " * 20) for i in range(9)], "doc_id long, text string"), str(tmp_path / "out"), length=16, rows=4)
    for shard in S.manifest(str(tmp_path / "out"))["shards"]:
        with pa.memory_map(str(tmp_path / "out" / f"{shard['name']}.arrow")) as f:
            t = pa.ipc.open_stream(f).read_all()
        assert t.schema.field("ids").type == pa.list_(pa.uint16(), 16) and t.num_rows == shard["sequences"]
        assert sum(pa.compute.sum(pa.array(m)).as_py() for m in t["mask"].to_pylist()) == shard["tokens"]


def test_access_copies_nothing(spark, tmp_path):
    S.write(spark.createDataFrame([(1, "some words here " * 2000)], "doc_id long, text string"), str(tmp_path / "out"), length=32, rows=8)
    s = S.Sequences(str(tmp_path / "out"))
    ids, mask = s[100]
    assert not ids.flags.owndata and not ids.flags.writeable
    blocks = s.blocks[0]
    whole = blocks.file
    whole.seek(0)
    base = whole.read_buffer(blocks.size).address
    assert base <= ids.ctypes.data < base + blocks.size and base <= mask.buffers()[1].address < base + blocks.size


def test_ties_nulls_hot_ids_and_empty_tables(spark, library):
    data = [(None, "no id"), (3, "b"), (3, "a a"), (3, "b"), (1, None), (2, "")] + [(3, "b")] * 40
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in S.report(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect())
    assert [(r[1], r[2]) for r in got[:2]] == [(1, 1), (2, 1)] and got[-1][1] is None and len(got) == len(data)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert sorted(r[3] for r in got) == sorted(r[3] for r in expected(data, library))
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts(spark, library):
    data = [(1, "one two, three " * 400_000), (2, "x" * 20_000), (3, "last")]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in S.report(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == expected(data, library)


def test_a_folder_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    S.write(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already"):
        S.write(df, str(tmp_path / "out"))
    assert S.documents(spark, str(tmp_path / "out")).count() == 1
