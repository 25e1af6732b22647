"""Document fingerprints as threshold-scaled sketches; DataFrame operations only.

A sketch keeps every hash of a text's word shingles that lies below a fixed ``1 / scale`` of the hash range, so two
sketches of very unequal texts can be compared, and the sketch of a union of shingle sets is the union of sketches.
Words: lower-cased, split at ``[\\x20\\x09-\\x0D]+``; shingles: ``SHINGLE`` consecutive words (a shorter text: all its words),
hashed as XXH64 of the words' XXH64.  If none lies below the threshold, the least hash is kept, so only texts without
words have empty sketches; merging keeps that rule.

``neighbours`` finds, for every document, the next one in a cyclic order without ordering the table in one task:
buckets are ranges of places, a place being doc_id and the hash of the text, so rows of equal or null doc_id are dealt
out too; every bucket's head is copied behind the preceding bucket's rows, and a window within the bucket does the
rest.  Texts are shuffled once.  There are at most ``BUCKETS`` buckets, of 128 rows up to 8 million documents and of a
65536th of all beyond; bounds and heads, two short strings a bucket, are all that comes to the driver.

Defined cases: null text is empty; the empty text has an empty sketch, alike only to another empty one; documents of
equal doc_id follow each other by the hash of their texts, those of null doc_id come last; a single document is its
own next; repeated rows are separate documents, and only they share a place; extra columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, SCALE, BUCKET_ROWS, BUCKETS, SAMPLE = 5, 8, 128, 1 << 16, 1 << 19


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of the text's shingles below the threshold, or the least one."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, shingle)))
        return let(hashed, lambda x: let(F.filter(x, lambda v: v < limit), lambda k: F.when((F.size(k) > 0) | (F.size(x) == 0), F.array_sort(F.array_distinct(k))).otherwise(F.array(F.array_min(x)))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles together."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    return let(F.array_sort(F.array_union(a, b)), lambda u: let(F.filter(u, lambda v: v < limit), lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(u, 1, 1))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null for an empty a."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def hexed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def bucket(key: Column, bounds: list[str]) -> Column:
    """Number of bounds at or below the key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(a, _):
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        below = (a["lo"] < a["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, step, lambda a: a["lo"])


def place(doc_id: Column, text: Column) -> Column:
    """A string that sorts by descending doc_id, null last, and then by the hash of the text."""
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    top = F.coalesce(sixteen(doc_id.cast("bigint").bitwiseXOR(F.lit((1 << 63) - 1))), F.lit("G"))
    return F.concat(top, F.lit("-"), sixteen(F.coalesce(F.xxhash64(text), F.lit(0))))


def neighbours(documents: DataFrame, *columns: str, bucket_rows: int = BUCKET_ROWS, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """The given columns with ``next``, a struct of those of the document next by descending doc_id (after the last: the first)."""
    key = place(F.col("doc_id"), F.col("text"))
    keys = documents.select(key.alias("k"))
    n = keys.count()
    many = max(1, min(buckets, -(-n // bucket_rows)))
    bounds: list[str] = []
    if many > 1:
        # A sample of at most about ``sample`` places by their hash: it sets how even the buckets are, and nothing else.
        rate = int(min(1.0, sample / n) * (1 << 40))
        some = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < rate).distinct().toArrow()["k"].to_pylist()
        some.sort()
        bounds = sorted({some[len(some) * i // many] for i in range(1, many)}) if some else []
    of = bucket(F.col("__k"), bounds)
    # One row a bucket: the first place of each, and the bucket whose rows it follows.
    heads = sorted((r.b, r.h) for r in keys.withColumnRenamed("k", "__k").groupBy(of.alias("b")).agg(F.min("__k").alias("h")).collect())
    follows = {b: before for (before, _), (b, _) in pairwise([*heads, *heads[:1]])}
    first = dict(heads)
    slots = range(len(bounds) + 1)
    head = F.get(F.split(F.lit(",".join(first.get(b, "") for b in slots)), ","), F.col("__b"))
    before = F.get(F.split(F.lit(",".join(str(follows.get(b, b)) for b in slots)), ","), F.col("__b")).cast("int")
    rows = documents.select(*columns, key.alias("__k")).withColumn("__b", of)
    own, ghost = F.struct(F.col("__b").alias("b"), F.lit(False).alias("g")), F.struct(before.alias("b"), F.lit(True).alias("g"))
    rows = rows.withColumn("__p", F.explode(F.when(F.col("__k") == head, F.array(own, ghost)).otherwise(F.array(own))))
    w = Window.partitionBy("__p.b").orderBy("__p.g", "__k")
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not __p.g").select(*columns, "next")


def report(documents: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every document and of its text with the last half replaced from the next document."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("sketch", sketch(F.col("text"), shingle, scale))
    docs = neighbours(docs, "doc_id", "text", "sketch").withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.col("next.text"), F.lit(1), half))
    docs = docs.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("other"), edited.alias("edited"))
    docs = docs.withColumn("changed", sketch(F.col("edited"), shingle, scale))
    return docs.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexed(F.col("sketch")).alias("fingerprint"),
        hexed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("changed")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("other")).alias("near_next"),
    )
