"""License scan with ordered signature rules; DataFrame expressions only, no shuffle.

The text is lower-cased (A-Z) and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Most documents are
settled by one regular expression over the raw text that every rule implies (the prefilter).  For the rest, each rule
is gated by its keyword and its regular expression is run over the words.  Detections are ordered by place; one that
lies within another of the same or higher priority is suppressed.  Base phrases are counted beside the rules and
never suppressed.

Defined cases: null or empty text has no words and no labels; detections of the same span are resolved by priority,
then by rule order; repeated rows are separate documents; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import lower_ascii

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, identifier as words, name as a regular expression over words, keyword that each of its texts contains.
FAMILIES = (
    ("mit", "mit", "mit license|mit x11 license|expat license|x11 license", "mit|expat|x11"),
    ("mit-0", "mit 0", "mit no attribution( license)?|mit 0 license", "mit"),
    ("apache-2.0", "apache 2 0", "apache (software )?license (version |v)?2( 0)?|apache 2 0 license|asl 2 0", "apache|asl"),
    ("apache-1.1", "apache 1 1", "apache (software )?license (version |v)?1 1", "apache"),
    ("apache-1.0", "apache 1 0", "apache (software )?license (version |v)?1 0", "apache"),
    ("gpl-1.0", "gpl 1 0", "(gnu )?(general public license|gpl) ?(version |v)?1( 0)?", "general|gpl|gplv1"),
    ("gpl-2.0", "gpl 2 0", "(gnu )?(general public license|gpl) ?(version |v)?2( 0)?|gplv2", "general|gpl|gplv2"),
    ("gpl-3.0", "gpl 3 0", "(gnu )?(general public license|gpl) ?(version |v)?3( 0)?|gplv3", "general|gpl|gplv3"),
    ("lgpl-2.0", "lgpl 2 0", "gnu library general public license( version| v)? ?2( 0)?", "library"),
    ("lgpl-2.1", "lgpl 2 1", "(gnu )?(lesser general public license|lgpl) (version |v)?2 1|lgplv2 1", "lesser|lgpl|lgplv2"),
    ("lgpl-3.0", "lgpl 3 0", "(gnu )?(lesser general public license|lgpl) (version |v)?3( 0)?|lgplv3", "lesser|lgpl|lgplv3"),
    ("agpl-3.0", "agpl 3 0", "(gnu )?(affero general public license|agpl) ?(version |v)?3( 0)?|agplv3", "affero|agpl|agplv3"),
    ("fdl-1.3", "gfdl 1 3", "gnu free documentation license( version)? 1 3", "documentation"),
    ("fdl-1.2", "gfdl 1 2", "gnu free documentation license( version)? 1 2", "documentation"),
    ("fdl-1.1", "gfdl 1 1", "gnu free documentation license( version)? 1 1", "documentation"),
    ("bsd-2-clause", "bsd 2 clause", "(simplified|freebsd) (bsd )?license|2 clause bsd license|two clause bsd license|bsd 2 clause license", "bsd|freebsd|simplified"),
    ("bsd-3-clause", "bsd 3 clause", "(new|revised|modified) bsd license|3 clause bsd license|three clause bsd license|bsd 3 clause license", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(original|old) bsd license|4 clause bsd license|bsd 4 clause license", "bsd"),
    ("0bsd", "0bsd", "bsd zero clause license|zero clause bsd license|0bsd license", "bsd|0bsd"),
    ("isc", "isc", "isc license|internet systems consortium license", "isc|internet"),
    ("mpl-1.0", "mpl 1 0", "mozilla public license (version |v)?1 0|mpl 1 0", "mozilla|mpl"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license (version |v)?1 1|mpl 1 1", "mozilla|mpl"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license (version |v)?2 0|mpl 2 0", "mozilla|mpl"),
    ("epl-1.0", "epl 1 0", "eclipse public license (version |v)?1 0|epl 1 0", "eclipse|epl"),
    ("epl-2.0", "epl 2 0", "eclipse public license (version |v)?2 0|epl 2 0", "eclipse|epl"),
    ("edl-1.0", "edl 1 0", "eclipse distribution license (version |v)?1 0", "eclipse"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license (version )?1 0|cddl 1 0", "development|cddl"),
    ("cddl-1.1", "cddl 1 1", "common development and distribution license (version )?1 1|cddl 1 1", "development|cddl"),
    ("cpl-1.0", "cpl 1 0", "common public license (version )?1 0", "common"),
    ("ipl-1.0", "ipl 1 0", "ibm public license (version )?1 0", "ibm"),
    ("artistic-1.0", "artistic 1 0", "artistic license (version )?1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", "artistic license (version )?2 0", "artistic"),
    ("perl", "perl 5", "same terms as perl( itself| 5)? license|perl 5 license", "perl"),
    ("php-3.01", "php 3 01", "php license (version )?3 01", "php"),
    ("python-2.0", "psf 2 0", "python software foundation license( version 2)?|psf license", "python|psf"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("zlib", "zlib", "zlib license|zlib libpng license", "zlib"),
    ("libpng", "libpng", "libpng license|png reference library license", "libpng|png"),
    ("openssl", "openssl", "openssl license|openssl ssleay license", "openssl"),
    ("boost-1.0", "bsl 1 0", "boost software license( version)?( 1 0)?", "boost"),
    ("busl-1.1", "busl 1 1", "business source license( version)?( 1 1)?", "business"),
    ("sspl-1.0", "sspl 1 0", "server side public license( version)?( 1)?", "server"),
    ("elastic-2.0", "elastic 2 0", "elastic license( version)?( 2 0)?", "elastic"),
    ("unlicense", "unlicense", "the unlicense|unlicense license", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license|wtfpl license", "wtfpl|fuck"),
    ("ofl-1.1", "ofl 1 1", "sil open font license( version)?( 1 1)?|open font license( version)?( 1 1)?", "font"),
    ("osl-3.0", "osl 3 0", "open software license( version)?( v)? 3 0", "open"),
    ("afl-3.0", "afl 3 0", "academic free license( version)?( v)? 3 0", "academic"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e( version| v)? 1 1|eupl 1 1", "european|eupl"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e( version| v)? 1 2|eupl 1 2", "european|eupl"),
    ("ms-pl", "ms pl", "microsoft public license", "microsoft|ms"),
    ("ms-rl", "ms rl", "microsoft reciprocal license", "microsoft|ms"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license|ncsa license", "ncsa"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("vim", "vim", "vim license", "vim"),
    ("curl", "curl", "curl license", "curl"),
    ("w3c", "w3c", "w3c software (notice and )?license", "w3c"),
    ("unicode", "unicode", "unicode license agreement|unicode license", "unicode"),
    ("odbl-1.0", "odbl 1 0", "open database license|odbl license", "database|odbl"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license|pddl license", "domain|pddl"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license", "odc|commons"),
    ("cc0-1.0", "cc0 1 0", "cc0( 1 0)?( universal)?( license)?|creative commons zero license", "cc0|creative"),
    ("cc-by-2.0", "cc by 2 0", "creative commons attribution 2 0( generic)?( license)?|cc by 2 0", "creative|cc"),
    ("cc-by-2.5", "cc by 2 5", "creative commons attribution 2 5( generic)?( license)?|cc by 2 5", "creative|cc"),
    ("cc-by-3.0", "cc by 3 0", "creative commons attribution 3 0( unported)?( license)?|cc by 3 0", "creative|cc"),
    ("cc-by-4.0", "cc by 4 0", "creative commons attribution 4 0( international)?( license)?|cc by 4 0", "creative|cc"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative commons attribution share ?alike 3 0( unported)?( license)?|cc by sa 3 0", "creative|cc"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative commons attribution share ?alike 4 0( international)?( license)?|cc by sa 4 0", "creative|cc"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "creative commons attribution non ?commercial 3 0( unported)?( license)?|cc by nc 3 0", "creative|cc"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative commons attribution non ?commercial 4 0( international)?( license)?|cc by nc 4 0", "creative|cc"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative commons attribution no ?deriv(ative)?s 4 0( international)?( license)?|cc by nd 4 0", "creative|cc"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0( international)?( license)?|cc by nc sa 4 0", "creative|cc"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( license)?|cc by nc nd 4 0", "creative|cc"),
)
#: Notices around a name, their priority and how sure they make a detection.
NOTICES = (
    ("spdx license identifier {id}", 5, 1.0),
    ("(licensed|released|distributed|published|available|covered|provided) under (the )?(terms (and conditions )?of )?(the )?({name})", 4, 0.95),
    ("(subject to|governed by|pursuant to|in accordance with) (the )?(terms (and conditions )?of )?(the )?({name})", 4, 0.9),
    ("({name})", 3, 0.8),
)
#: Texts and notices that name no version: label, regular expression, keyword, priority, weight.
LONE = (
    ("gpl", "gnu general public license|gnu gpl|gpl license", "gnu|gpl", 2, 0.7),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 4, 0.95),
    ("gpl", "you should have received a copy of the gnu general public license", "received", 4, 0.9),
    ("gpl", "gnu general public license as published by the free software foundation", "foundation", 4, 0.9),
    ("lgpl", "gnu lesser general public license|gnu lgpl", "lesser|lgpl", 2, 0.7),
    ("agpl", "gnu affero general public license|gnu agpl", "affero|agpl", 2, 0.7),
    ("fdl", "gnu free documentation license", "documentation", 2, 0.7),
    ("apache", "apache (software )?license|http www apache org licenses", "apache", 2, 0.7),
    ("apache-2.0", "https? www apache org licenses license 2 0", "apache", 5, 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby", 4, 0.95),
    ("mit", "https? opensource org licenses mit", "opensource", 5, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 4, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 4, 0.9),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "endorse", 5, 0.95),
    ("bsd", "bsd (style )?license", "bsd", 2, 0.7),
    ("mpl", "mozilla public license", "mozilla", 2, 0.7),
    ("mpl-2.0", "https? mozilla org mpl 2 0", "mozilla", 5, 1.0),
    ("epl", "eclipse public license", "eclipse", 2, 0.7),
    ("cddl", "common development and distribution license", "development", 2, 0.7),
    ("artistic", "artistic license", "artistic", 2, 0.7),
    ("cc-by", "creative commons attribution( license)?|cc by( license)?", "creative|cc", 2, 0.7),
    ("cc-by-sa", "creative commons attribution share ?alike( license)?|cc by sa( license)?", "creative|cc", 2, 0.75),
    ("cc-by-nc", "creative commons attribution non ?commercial( license)?|cc by nc( license)?", "creative|cc", 2, 0.75),
    ("cc-by-nd", "cc by nd( license)?", "cc", 2, 0.75),
    ("cc-by-nc-sa", "cc by nc sa( license)?", "cc", 2, 0.78),
    ("cc-by-nc-nd", "cc by nc nd( license)?", "cc", 2, 0.78),
    ("creative-commons", "creative commons license|https? creativecommons org licenses", "creative|creativecommons", 1, 0.6),
    ("public-domain", "(released|placed|dedicated) (in|into|to) the public domain", "domain", 3, 0.85),
    ("public-domain", "(is|are) in the public domain", "domain", 2, 0.7),
    ("proprietary", "all rights reserved", "reserved", 1, 0.5),
    ("proprietary", "proprietary and confidential|confidential and proprietary", "confidential", 2, 0.7),
    ("eula", "end user license agreement", "agreement", 2, 0.7),
    ("license-reference", "see (the )?license (file )?for (more )?(details|information)", "license", 1, 0.4),
    ("license-reference", "licensed under (the )?same (terms|license)", "licensed", 1, 0.4),
)


#: Words that patterns match where they allow no space after a keyword.
GLUED = {"gpl": "gpl1|gpl2|gpl3|gplversion", "agpl": "agpl3|agplversion"}


def wide(pattern: str) -> str:
    """A pattern over words as one over `` w0  w1  w2 ``, where every word has a space of its own on either side."""
    return f" (?:{pattern.replace(' ?', '(?:__)?').replace(' ', '__').replace('__', '  ')}) "


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keywords, pattern, priority, weight), in rule order; any of the keywords opens the gate."""
    found = []
    for label, ident, name, keywords in FAMILIES:
        for notice, priority, weight in NOTICES:
            found.append((label, "spdx" if "{id}" in notice else keywords, notice.format(id=ident, name=name), priority, weight))
    found += [(label, keyword, pattern, priority, weight) for label, pattern, keyword, priority, weight in LONE]
    return [(label, "|".join(f" {k} " for k in keyword.split("|")), wide(pattern), priority, weight) for label, keyword, pattern, priority, weight in found]


def gate(keywords: str) -> str:
    """The keywords of ``rules`` with the words that ``GLUED`` adds to them."""
    more = [f" {w} " for k in keywords.split("|") for w in GLUED.get(k.strip(), "").split("|") if w]
    return "|".join([keywords, *more])


SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every rule and base phrase implies a match of this on the raw text.
PREFILTER = rf"(?i)licen[cs]|gpl|cc{SEP}by|(?<![a-zA-Z0-9])(?:cc0|mpl|epl|eupl|cddl)|public{SEP}domain|hereby|redistribution|endorse|rights{SEP}reserved|proprietary|commons|mozilla|asl{SEP}2{SEP}0|mit{SEP}no{SEP}attribution"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def places(norm: Column, pattern: Column) -> Column:
    """[(first, last)] words of every match of the pattern; norm has two spaces a word, and so do matches."""
    between = F.split(norm, pattern, -1)
    hits = F.regexp_extract_all(norm, pattern, F.lit(0))
    words = lambda x: (spaces(x) / 2).cast("int")
    step = lambda a, h: F.struct(
        (a["at"] + words(h) + words(F.get(a["parts"], a["i"] + 1))).alias("at"),
        (a["i"] + 1).alias("i"),
        a["parts"].alias("parts"),
        F.concat(a["out"], F.array(F.struct(a["at"].alias("first"), (a["at"] + words(h) - 1).alias("last")))).alias("out"),
    )
    start = F.struct(words(F.get(between, F.lit(0))).alias("at"), F.lit(0).alias("i"), between.alias("parts"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("out"))
    return F.aggregate(hits, start, step, lambda a: a["out"])


def scan(documents: DataFrame, *keep: Column) -> DataFrame:
    """(row, n_words, base, found, labels...) for every document; found lists (rule, label, first, last, weight) after suppression."""
    kept = keep or (F.col("doc_id"),)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.struct(*kept).alias("row"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"), F.when(text.rlike(PREFILTER), text).alias("gated"))
    # One space before and after every word.
    norm = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower_ascii(F.col("gated")), F.lit(f"({WORD})"), F.lit(0)), "  "), F.lit(" "))
    docs = docs.withColumn("norm", norm)
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(gate(key)).alias("key"), F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight")) for i, (label, key, pattern, priority, weight) in enumerate(rules())])
    named = lambda at, label: F.transform(at, lambda x: F.struct(x["first"].alias("first"), F.lit(label).alias("label")))
    base_at = [named(places(F.col("norm"), F.lit(" " + "  ".join(p.split()) + " ")), label) for p, label in BASE.items()]
    docs = docs.withColumn("base", F.when(F.col("norm").isNotNull(), F.concat(*base_at)))
    opened = F.filter(table, lambda r: F.exists(F.split(r["key"], r"\|"), lambda k: F.contains(F.col("norm"), k)))
    seen = F.flatten(F.transform(opened, lambda r: F.transform(places(F.col("norm"), r["pattern"]), lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("back"), (-r["priority"]).alias("low"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))))
    docs = docs.withColumn("seen", F.when(F.col("norm").isNotNull(), F.array_sort(seen)))
    none = F.expr("cast(array() as array<struct<rule:int,label:string,first:int,last:int,weight:double>>)")
    levels = max(r[3] for r in rules())
    reach = F.array(*[F.lit(-1)] * levels)

    def step(a, x):
        last, priority = -x["back"], -x["low"]
        under = F.get(a["reach"], priority - 1) >= last
        grown = F.transform(a["reach"], lambda r, i: F.when(i < priority, F.greatest(r, last)).otherwise(r))
        one = F.array(F.struct(x["rule"].alias("rule"), x["label"].alias("label"), x["first"].alias("first"), last.alias("last"), x["weight"].alias("weight")))
        return F.struct(grown.alias("reach"), F.when(under, a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    found = F.aggregate("seen", F.struct(reach.alias("reach"), none.alias("out")), step, lambda a: a["out"])
    return docs.withColumn("found", F.when(F.size("seen") > 0, found)).select("row", "n_words", "base", "found")


def report(documents: DataFrame, *keep: Column) -> DataFrame:
    """``scan`` with counts, labels and a score: the weight of the surest detection, a base phrase counting 0.6."""
    got = scan(documents, *keep)
    labels = lambda c: F.coalesce(F.transform(c, lambda x: x["label"]), F.array().cast("array<string>"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    firsts = F.transform("base", lambda x: x["first"])
    n = F.when(F.size("base") > 0, F.size("base")).otherwise(0)
    return got.withColumns({
        "n_base": n.cast("bigint"),
        "first_word": F.array_min(firsts).cast("bigint"),
        "last_word": F.array_max(firsts).cast("bigint"),
        "base_labels": joined(labels(F.col("base"))),
        "labels": joined(F.concat(labels(F.col("base")), labels(F.col("found")))),
        "score": F.greatest(F.when(n > 0, F.lit(0.6)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0))),
    })


def sql() -> str:
    """The same as DuckDB SQL: rules as a table, suppression as an anti-join."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(a)}, {quote(gate(k))}, {quote(p)}, {n}, {w}::DOUBLE)" for i, (a, k, p, n, w) in enumerate(rules()))
    base = ", ".join(f"({quote(' ' + '  '.join(p.split()) + ' ')}, {quote(a)})" for p, a in BASE.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at = "CAST((list_sum([len(x) - len(replace(x, ' ', '')) for x in parts[1 : i]]) + coalesce(list_sum([len(x) - len(replace(x, ' ', '')) for x in hits[1 : i - 1]]), 0)) / 2 AS BIGINT)"
    spans = f"{at} AS first, {at} + CAST((len(hits[i]) - len(replace(hits[i], ' ', ''))) / 2 AS BIGINT) - 1 AS last"
    cut = lambda source, pattern: f"SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT *, string_split_regex(norm, {pattern}) AS parts, regexp_extract_all(norm, {pattern}) AS hits FROM {source})"
    return f"""
WITH rules(rule, label, keys, pattern, priority, weight) AS (VALUES {values}), phrases(pattern, label) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS r, doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
b AS (SELECT r, label, {spans} FROM ({cut("(SELECT r, norm, label, pattern FROM d, phrases WHERE contains(norm, pattern))", "pattern")})),
bases AS (SELECT r, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
s AS (SELECT r, rule, label, priority, weight, {spans} FROM ({cut("(SELECT r, norm, rule, label, pattern, priority, weight FROM d, rules WHERE len(list_filter(string_split(keys, '|'), lambda k: contains(norm, k))) > 0)", "pattern")})),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.r = s.r AND o.first <= s.first AND o.last >= s.last AND o.priority >= s.priority
      AND (o.first, -o.last, -o.priority, o.rule) < (s.first, -s.last, -s.priority, s.rule))),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM k UNION ALL SELECT r, label FROM b) GROUP BY r),
w AS (SELECT r, max(weight) AS weight FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, coalesce(weight, 0.0::DOUBLE)) AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN l USING (r) LEFT JOIN w USING (r)
"""
