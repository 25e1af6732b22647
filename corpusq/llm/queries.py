"""Queries over the dealt operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import decontam, kdtree, langid, licenses, lm, mix, quality, ranked, sequences, simhash, sketch, substring, tokens
from corpusq.llm.common import table

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased, as DuckDB SQL.
SQL_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = "regexp_extract_all(" + SQL_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, m, array_to_string(w[k + 1 : k + m], ' ') AS g
         FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM wins),
grams AS (SELECT r, m, k, array_to_string(w[k + 1 : k + m], ' ') AS g
          FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS k FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT grams.r, grams.k, grams.m, wins.item FROM grams JOIN wins USING (m, g)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.report(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op11_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.report(table(spark, sf_dir, "documents"))


def op12_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.report(table(spark, sf_dir, "embeddings"))


def equal_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 without its near passages: what SQL can express."""
    return substring.report(table(spark, sf_dir, "documents"), similarity=None)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


EQUAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {SQL_WORDS.format("text")} AS w FROM documents),
g AS (SELECT r, doc_id, k, array_to_string(w[k + 1 : k + 50], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)),
s AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(DISTINCT r) > 1),
h AS (SELECT r, k, least FROM g JOIN s USING (g)),
p AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS p FROM h),
i AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM p),
spans AS (SELECT r, island, min(p) AS a, max(p) AS b FROM i GROUP BY r, island),
t AS (SELECT r, sum(b - a + 1)::BIGINT AS n_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY r),
c AS (SELECT text, count(*) AS copies FROM documents GROUP BY text),
l AS (SELECT r, min(least) AS first_doc_id FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, n_repeated, copies, first_doc_id, spans FROM d JOIN t USING (r) JOIN l USING (r) JOIN c USING (text)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_simhash": op2_simhash, "op3_licenses": op3_licenses, "op4_sketch": op4_sketch, "op5_langid": op5_langid, "op6_mix": op6_mix, "op7_tokens": op7_tokens, "op8_lm": op8_lm, "op9_substring": op9_substring, "equal_passages": equal_passages, "op10_quality": op10_quality, "op11_binary": op11_binary, "op12_tput": op12_tput, "op13_kdtree": op13_kdtree}
ORACLE = {"op1_decontaminate": OP1, "op3_licenses": licenses.sql(), "op6_mix": mix.SQL, "op12_tput": ranked.SQL, "op13_kdtree": kdtree.SQL, "equal_passages": EQUAL}
