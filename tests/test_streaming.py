import datetime as dt

from pyspark.sql import functions as F

from corpusq.streaming import jobs


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, "file_id string, ts timestamp, status string").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_states_and_resume(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    source = str(tmp_path / "in")
    schema = "file_id string, ts timestamp, status string"
    seen: dict = {}

    def run():
        rows = jobs.states(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source))
        keep = lambda df, n: [seen.setdefault(r.file_id, []).append((r.status, r.rejected)) for r in df.collect()]
        rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    write(spark, source, "a", [("f", at(1), "pending"), ("f", at(2), "indexing"), ("g", at(1), "pending")])
    run()
    assert seen == {"f": [("indexing", 0)], "g": [("pending", 0)]}
    write(spark, source, "b", [("f", at(3), "indexed"), ("g", at(2), "indexed")])
    run()
    assert seen == {"f": [("indexing", 0), ("indexed", 0)], "g": [("pending", 0), ("pending", 1)]}


def test_states_of_many_keys_without_python_per_key(spark, tmp_path):
    """Moves out of order, unknown and repeated ones, over two runs; no Python work for each key is in the plan."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    source, seen = str(tmp_path / "in"), {}
    write(spark, source, "a", [(f"k{i}", at(2), "indexing") for i in range(50)] + [(f"k{i}", at(1), "pending") for i in range(50)])
    rows = jobs.states(spark.readStream.schema("file_id string, ts timestamp, status string").option("recursiveFileLookup", True).parquet(source))
    assert "InPandas" not in rows._jdf.queryExecution().toString()
    keep = lambda df, n: seen.update({r.file_id: (r.status, r.rejected) for r in df.collect()})
    run = lambda: rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert seen == {f"k{i}": ("indexing", 0) for i in range(50)}
    # A late move of an earlier time counts when it arrives, and only this batch's unknown moves are rejected.
    write(spark, source, "b", [("k1", at(0), "failed"), ("k1", at(3), "nonsense"), ("k1", at(4), "indexed"), ("k2", at(3), "indexing"), ("k3", at(3), "indexed"), ("k3", at(3), "failed")])
    run()
    assert (seen["k1"], seen["k2"], seen["k3"], seen["k4"]) == (("failed", 2), ("indexing", 1), ("failed", 1), ("indexing", 0))
    write(spark, source, "c", [("k1", at(5), "pending")])
    run()
    assert seen["k1"] == ("pending", 0)


def test_incoming_files_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    got: list = []
    take = lambda df, n: got.extend(r.path.rpartition("/")[2] for r in df.select("path").collect())
    for name in ("b.md", None):
        jobs.once(jobs.incoming(spark, str(folder), "*.md"), str(tmp_path / "ck"), take)
        if name:
            (folder / name).write_text("two")
    assert got == ["a.md", "b.md"]


def test_windows_signature_and_webhook(spark, tmp_path):
    e = spark.range(10).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("id") * 20).cast("int"))).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit(7).alias("user_id"))
    assert [r.n for r in jobs.tumbling(e).orderBy("start").collect()] == [3, 3, 3, 1]
    assert [r.n for r in jobs.sessions(e).collect()] == [10]
    body, sign = jobs.signed({"b": 1, "a": "é"}, "key")
    assert body == '{"a":"é","b":1}'.encode() and len(sign) == 64
    out = str(tmp_path / "sent")
    open(out, "w").close()

    def send(body, sign):
        with open(out, "a") as f:
            f.write(body.decode() + "\n")

    rows = spark.createDataFrame([("f", "p", "added", "s", 1), ("f", "p", "modified", "s2", 2)], "file_id string, file_path string, action string, summary string, ts int")
    jobs.webhook(send, "k", "proj")(rows, 0)
    assert open(out).read().count("modified") == 1 and "added" not in open(out).read()
