"""Structured Streaming: incremental indexing, states, feeds, and windows over events.

The windowed aggregations are additions of this engine; the rest stands for queues, feeds and resumable jobs.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.changes import STATES, change_feed


def events(spark: SparkSession, path: str, schema: str, per_trigger: int = 2) -> DataFrame:
    """A file source; ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def incoming(spark: SparkSession, root: str, pattern: str = "*", per_trigger: int = 2) -> DataFrame:
    """New files below a folder with their bytes; the checkpoint makes a stopped job go on where it was."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)


def once(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run over all that has arrived and stop; write gets every batch with its number."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def jobs(df: DataFrame, key: str = "file_id", delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """One job a key within the delay."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def states(df: DataFrame, key: str = "file_id", status: str = "status") -> DataFrame:
    """The state of every key after each batch; moves that the state machine doesn't know are marked and leave the state.

    An aggregation in the engine, without Python for each key: the moves of a key stay in the stream's state and are
    folded in the order of their batches, times and names.  ``rejected`` counts the unknown moves of the last batch.
    """
    known = [f"{a}>{b}" for a, to in STATES.items() for b in sorted(to)]

    def step(s, m):
        ok = s["now"].isNull() | F.coalesce(F.concat(s["now"], F.lit(">"), m["status"]).isin(*known), F.lit(False))
        bad = F.when(s["batch"] == m["batch"], s["bad"]).otherwise(0) + F.when(ok, 0).otherwise(1)
        return F.struct(F.when(ok, m["status"]).otherwise(s["now"]).alias("now"), bad.alias("bad"), m["batch"].alias("batch"))

    move = F.struct(F.current_timestamp().alias("batch"), F.col("ts"), F.col(status).alias("status"))
    moves = df.select(key, move.alias("move")).groupBy(key).agg(F.array_sort(F.collect_list("move")).alias("moves"))
    first = F.struct(F.lit(None).cast("string").alias("now"), F.lit(0).alias("bad"), F.lit(None).cast("timestamp").alias("batch"))
    return moves.select(key, F.reduce("moves", first, step).alias("s")).select(key, F.col("s.now").alias("status"), F.col("s.bad").alias("rejected"))


def feed(df: DataFrame, by: str = "event_type") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def signed(payload: dict, secret: str) -> tuple[bytes, str]:
    """A payload's bytes and their HMAC-SHA256."""
    body = json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()
    return body, hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def webhook(send: Callable[[bytes, str], None], secret: str, project: str) -> Callable[[DataFrame, int], None]:
    """For ``once``: the last change of every path of a batch, sent by the tasks in signed messages of at most 1000 changes."""

    def write(batch: DataFrame, number: int) -> None:
        changes = change_feed(batch)

        def partition(rows: Iterator) -> None:
            held = []
            for r in rows:
                held.append(r.asDict())
                if len(held) == 1000:
                    send(*signed({"project_id": project, "batch": number, "changes": held}, secret))
                    held.clear()
            if held:
                send(*signed({"project_id": project, "batch": number, "changes": held}, secret))

        changes.select("file_id", "file_path", "action", "summary").foreachPartition(partition)

    return write
