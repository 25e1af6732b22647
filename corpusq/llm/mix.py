"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks; DataFrame operations only.

Size of a document: its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources in code-point order, null last, get the
weights of ``WEIGHTS`` in turn and share all words by them; a target stops at ``most`` times its source's size and
the excess is shared again among the others by weight (water filling, in closed form over the sources sorted by
capacity per weight).  Blocks of ``block`` words go to sources by the highest quotients target / (2k + 1), and each
source's blocks to its shards in the same way, by size.  Within a shard, documents stand in a seeded order; a quota
takes the whole shard as often as it fits, and the rest as the first blocks of that order.

A shard is a class of documents within a source, by a hash of doc_id and text, so a hot source, or many rows of one or
no doc_id, are dealt to many tasks; a source has at most ``shards`` of them, which bounds the per-source apportionment.
Only sizes are shuffled, never texts.  Sources are ordered in one task, one short row each.

Defined cases: null or empty text has size 0 and nothing is taken of it; a source without words has target 0; rows
of equal doc_id are separate documents, and only repeated rows tie in the seeded order; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import cut

WEIGHTS, MOST, BLOCK, SEED, SHARDS, SHARD_DOCS = (5, 2, 1), 3, 16, "mix", 4096, 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quotas(rows: DataFrame, tau: str, total: str, order: list[str], within: list[str]) -> DataFrame:
    """Column blocks: whole numbers that add up to ``total`` in each group, by the highest quotients tau / (2k + 1).

    Rounding tau gives each row all seats at divisor 1; the few seats by which the sum is off are then given to the
    highest next quotients, or taken from the lowest last ones.  A row can change by at most its share of 1.5 times
    the number of rows, plus 1, so that many candidate seats a row are enough.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("__q", F.floor(F.col(tau) + 0.5)).withColumns({"__off": F.col(total) - F.sum("__q").over(w), "__n": F.count("*").over(w), "__all": F.sum(tau).over(w)})
    share = F.coalesce(F.ceil(1.5 * F.col("__n") * F.col(tau) / F.nullif(F.col("__all"), F.lit(0.0))), F.lit(0)).cast("int") + 2
    seats = F.when(F.col("__off") > 0, share).when(F.col("__off") < 0, F.least(share, F.col("__q").cast("int"))).otherwise(0)
    many = rows.where((F.col("__off") != 0) & (seats > 0)).withColumn("__j", F.explode(F.sequence(F.lit(0), seats - 1)))
    k = F.when(F.col("__off") > 0, F.col("__q") + F.col("__j")).otherwise(F.col("__q") - 1 - F.col("__j"))
    many = many.withColumn("__v", F.col(tau) / (2 * k + 1) * F.when(F.col("__off") > 0, -1).otherwise(1))
    ranked = many.withColumn("__r", F.row_number().over(w.orderBy("__v", *order))).where(F.col("__r") <= F.abs("__off"))
    moved = ranked.groupBy(*within, *order).agg(F.sum(F.signum("__off")).cast("bigint").alias("__d"))
    return rows.join(moved, [*within, *order], "left").withColumn("blocks", (F.col("__q") + F.coalesce("__d", F.lit(0))).cast("bigint")).drop("__q", "__off", "__n", "__all", "__d")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources(key, source, source_size) with pos, total and target; one row per source, so a single task may order them."""
    one = Window.partitionBy(F.lit(0))
    pos = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("pos", pos).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(one))
    before = one.orderBy(F.col("cap") / F.col("w"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    s = s.withColumn("level", (F.col("total") - F.col("caps")).cast("double") / F.col("left"))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "pos", "level"))).over(one)["level"]
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).select("key", "pos", "source_size", "total", "target")


def mix(documents: DataFrame, *keep: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """(row, size, source_size, target, taken) for every document; row is a struct of the kept columns."""
    kept = keep or (F.col("doc_id"),)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    docs = documents.select(F.struct(*kept).alias("row"), "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), size_of(F.col("text")).alias("size"), order.alias("h"), F.col("doc_id").alias("id"))
    docs = cut(docs)
    n = max(1, min(shards, -(-docs.count() // SHARD_DOCS)))
    docs = docs.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 7), 16, 10).cast("int"), F.lit(n)))
    parts = cut(docs.groupBy("key", "source", "shard").agg(F.sum("size").alias("z")))
    sources = targets(parts.groupBy("key", "source").agg(F.sum("z").alias("source_size")), weights, most)
    sources = sources.withColumns({"tau": F.col("target") / block, "want": F.floor(F.col("total") / block + 0.5)})
    sources = cut(quotas(sources, "tau", "want", ["pos"], []).select("key", "source_size", "target", F.col("blocks").alias("quota")))
    by = parts.select("key", "shard", "z").join(sources, "key")
    by = by.withColumn("part", F.coalesce(F.col("quota") * F.col("z") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    by = quotas(by, "part", "quota", ["shard"], ["key"]).withColumn("words", F.least(F.col("blocks") * block, most * F.col("z")))
    by = cut(by.select("key", "shard", "z", "source_size", "target", "words"))
    w = Window.partitionBy("key", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = docs.join(by, ["key", "shard"]).withColumn("before", F.sum("size").over(w) - F.col("size"))
    times = F.coalesce(F.floor(F.col("words") / F.nullif(F.col("z"), F.lit(0))), F.lit(0)).cast("bigint")
    rows = rows.withColumn("times", times).withColumn("rest", F.col("words") - F.col("times") * F.col("z"))
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("row", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


#: The same as DuckDB SQL, from the statement of the method.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT greatest(1, least(4096, CAST(ceil(count(*) / 1024.0) AS BIGINT))) AS n FROM d),
e AS (SELECT d.*, CAST('0x' || substr(h, 1, 7) AS BIGINT) % n.n AS shard FROM d, n),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][pos % 3 + 1] AS w, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level * w >= cap THEN CAST(cap AS DOUBLE) ELSE w * (SELECT x.level FROM l x WHERE x.level * x.w < x.cap ORDER BY CAST(x.cap AS DOUBLE) / x.w, x.pos LIMIT 1) END AS target FROM l),
seats AS (SELECT source, pos, (target / 16) / (2 * k + 1) AS v, floor(CAST(total AS DOUBLE) / 16 + 0.5) AS want
          FROM (SELECT *, unnest(range(0, CAST(ceil(target / 16) AS BIGINT) + 2)) AS k FROM t)),
quota AS (SELECT source, sum(CASE WHEN rn <= want THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, row_number() OVER (ORDER BY v DESC, pos) AS rn FROM seats) GROUP BY source),
p AS (SELECT source, shard, sum(size)::BIGINT AS z FROM e GROUP BY source, shard),
parts AS (SELECT p.*, quota, coalesce(CAST(quota * z AS DOUBLE) / nullif(source_size, 0), 0) AS part FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source JOIN quota ON p.source IS NOT DISTINCT FROM quota.source),
pseats AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v DESC, shard) AS rn FROM
           (SELECT source, shard, quota, part / (2 * k + 1) AS v FROM (SELECT *, unnest(range(0, CAST(ceil(part) AS BIGINT) + 2)) AS k FROM parts))),
words AS (SELECT source, shard, sum(CASE WHEN rn <= quota THEN 1 ELSE 0 END)::BIGINT AS blocks FROM pseats GROUP BY source, shard),
f AS (SELECT e.*, p.z, least(words.blocks * 16, 3 * p.z) AS words, (sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY h, doc_id, size, r ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
      FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.shard = p.shard JOIN words ON e.source IS NOT DISTINCT FROM words.source AND e.shard = words.shard)
SELECT f.doc_id, f.size, t.source_size, t.target,
       (CASE WHEN z = 0 THEN 0 ELSE words // z * size + greatest(0, least(size, words - words // z * z - before)) END)::BIGINT AS taken
FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
"""
