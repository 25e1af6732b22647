"""Change detection, merges, deletions and states, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(current: DataFrame, previous: DataFrame, keys: list[str], hash_col: str = "hash", archive: str | None = None) -> DataFrame:
    """Keys with an action: added, modified, unchanged or removed; an unchanged file without archive is modified."""
    a = current.select(*keys, F.col(hash_col).alias("__new"), F.lit(True).alias("__a"))
    b = previous.select(*keys, F.col(hash_col).alias("__old"), (F.col(archive) if archive else F.lit(True)).alias("__archived"), F.lit(True).alias("__b"))
    same = F.col("__new").eqNullSafe(F.col("__old")) & F.coalesce("__archived", F.lit(False))
    action = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def removed(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    return previous.join(current, keys, "left_anti")


def resume(persisted: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Persisted rows, and those of the snapshot that aren't persisted."""
    return persisted.unionByName(snapshot.join(persisted, keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``old`` with the given columns from ``new`` where it has the key, and the rows that only ``new`` has."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new.columns if c != key], F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    pick = [F.when(F.col("__new") & (F.lit(c in columns) | F.col("__old").isNull()), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c != key]
    return o.join(n, key, "full_outer").select(key, *pick).select(*old.columns)


def soft_delete(rows: DataFrame, key: str, ids: list, at: str | None = None) -> DataFrame:
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return rows.withColumn("deleted_at", F.when(F.col(key).isin(*ids), when).otherwise(F.col("deleted_at")) if ids else F.col("deleted_at"))


def compact(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at is null")


def tombstones(rows: DataFrame) -> DataFrame:
    n, gone = F.count("*"), F.count_if(F.col("deleted_at").isNotNull())
    return rows.agg((n - gone).alias("live"), gone.alias("deleted"), F.coalesce(F.try_divide(gone.cast("double"), n), F.lit(0.0)).alias("ratio"))


def move(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """A path prefix rewritten, at its first occurrence, in all rows that have it."""
    return rows.withColumn(path, F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(F.col(path), len(old) + 1, 1 << 30))).otherwise(F.col(path)))


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("s")).select(key, *[f"s.{c}" for c in columns])


#: File states and the moves between them.
STATES = {"pending": {"indexing"}, "importing": {"embedding", "indexed", "failed"}, "embedding": {"indexed", "failed"}, "indexing": {"indexed", "failed"}, "indexed": {"pending", "indexing"}, "failed": {"pending", "indexing"}}


def bad_moves(events: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """Transitions that the state machine doesn't know."""
    w = Window.partitionBy(key).orderBy(order)
    allowed = F.create_map(*[x for a, b in STATES.items() for x in (F.lit(a), F.array(*map(F.lit, sorted(b))))])
    rows = events.withColumn("before", F.lag(status).over(w)).where("before is not null")
    return rows.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("before")), F.col(status)), F.lit(False)))


def merge_failed(rows: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Files marked failed, with the first 500 characters of the message."""
    f = failures.groupBy(key).agg(F.left(F.min("message"), F.lit(500)).alias("__m"))
    return rows.join(f, key, "left").withColumns({"status": F.when(F.col("__m").isNotNull(), "failed").otherwise(F.col("status")), "error_message": F.coalesce("__m", "error_message")}).drop("__m")


def change_feed(changes: DataFrame, path: str = "file_path", order: str = "ts") -> DataFrame:
    """One change a path: the last one written."""
    w = Window.partitionBy(path).orderBy(F.col(order).desc())
    return changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
