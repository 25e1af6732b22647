import random
import re
from itertools import product
from re import _constants, _parser

import pytest
from pyspark.sql import functions as F

from corpusq.llm import licenses as L


def brute(text):
    """(n_words, base places, surviving detections) by plain loops."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for p, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    norm = " " + "  ".join(words) + " "
    seen = []
    for k, (label, keys, pattern, priority, weight) in enumerate(L.rules()):
        if any(x in norm for x in keys.split("|")):
            for m in re.finditer(pattern, norm):
                a = norm[: m.start()].count(" ") // 2
                seen.append((a, -(a + m[0].count(" ") // 2 - 1), -priority, k, label, weight))
    seen.sort()
    kept = [x for i, x in enumerate(seen) if not any(o[0] <= x[0] and o[1] <= x[1] and o[2] <= x[2] for o in seen[:i])]
    return len(words), base, kept


def test_rules():
    rules = L.rules()
    assert len(rules) > 200
    for _, _, pattern, _, _ in rules:
        re.compile(pattern)
    words, base, kept = brute("Licensed under the Apache License, Version 2.0; CC-BY 4.0. SPDX-License-Identifier: MIT")
    assert {x[4] for x in kept} == {"apache-2.0", "cc-by-4.0", "mit"}
    assert {b for _, b in base} == {"apache", "cc-by"}


def test_scan_matches_brute_force(spark):
    rnd = random.Random(6)
    bits = ["Licensed under the MIT License.", "GNU General Public License version 3", "mit license mit license", "CC-BY", "cc by sa 4.0", "Apache License", "https://www.apache.org/licenses/LICENSE-2.0", "all rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "the public domain", "gplv2", "É_cc_by", "SPDX-License-Identifier: BSD-3-Clause", "released into the public domain", "exampl", "Mozilla Public License 2.0", "Lizenz\tdes 中文"]
    docs = [(i, " ".join(rnd.choice(bits + ["word", "w\n"]) for _ in range(rnd.randrange(0, 12)))) for i in range(120)]
    docs += [(1, docs[1][1]), (None, "mit license"), (500, None), (501, ""), (502, "x " * 20000 + "mit license " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1))
    got = sorted((str(tuple(r)) for r in L.report(df).selectExpr("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()))
    want = []
    for i, t in docs:
        n, base, kept = brute(t)
        at = [a for a, _ in base]
        labels = {b for _, b in base}
        score = max([0.6 if base else 0.0, *(x[5] for x in kept)])
        want.append(str((i, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in kept})), score)))
    assert got == sorted(want)
    assert L.report(df.limit(0)).count() == 0


def every(tree):
    """A text of every alternative of a parsed pattern."""
    parts = []
    for op, v in tree:
        if op is _constants.LITERAL:
            parts.append([chr(v)])
        elif op is _constants.ANY:
            parts.append(["x"])
        elif op is _constants.IN:
            parts.append([chr(x) for _, x in v])
        elif op is _constants.SUBPATTERN:
            parts.append(every(v[3]))
        elif op is _constants.BRANCH:
            parts.append([x for t in v[1] for x in every(t)])
        else:
            parts.append([""] * (v[0] == 0) + every(v[2]))
    return ["".join(x) for x in product(*parts)]


def test_every_rule_passes_prefilter_and_gate(spark):
    rules, texts = L.rules(), []
    for _, keys, pattern, priority, _ in rules:
        found = every(_parser.parse(pattern))
        assert all(re.search(pattern, x) and any(k in x for k in L.gate(keys).split("|")) for x in found)
        assert all(re.search(L.PREFILTER, " ".join(x.split())) for x in found)
        texts += [" ".join(x.split()) for x in (found if len(found) < 12 else found[:: len(found) // 6])]
    texts = sorted({*texts, "Released under ASL 2.0", "MIT No Attribution", "GPL2", "GNU GPL1", "GPL3", "AGPL3", "agplversion 3"})
    got = {r.t: {x.label for x in r.found or []} for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text").alias("t")).select("row.t", "found").collect()}
    for t in texts:
        norm = " " + "  ".join(re.findall(r"[a-z0-9]+", t.lower())) + " "
        seen = sorted((m.start(), -m.end(), -p, k, label) for k, (label, _, pattern, p, _) in enumerate(rules) for m in re.finditer(pattern, norm))
        assert got[t] == {x[4] for i, x in enumerate(seen) if not any(o[1] <= x[1] and o[2] <= x[2] for o in seen[:i])}, t


def test_sql_finds_what_the_query_finds(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["GPL2", "under GPL3 or AGPL3", "gplversion 2", "agplversion 3", "GNU GPL1, later GPL 2", "Released under ASL 2.0", "mit license MIT No Attribution", "nothing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = df.toPandas()
    c = duckdb.connect()
    c.register("documents", documents)
    want = sorted(str(tuple(r)) for r in c.sql(L.sql()).fetchall())
    got = L.report(df).selectExpr("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {r.doc_id for r in got if "gpl" in r.labels} == {0, 1, 2, 3, 4}
