import random

from corpusq.llm import decontam as D


def rows(df):
    return sorted(tuple(r) for r in df.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def planted(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Zz", "a"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", ", ", "  "]) for _ in range(n))
    items = [(i, text(rnd.randrange(0, 40))) for i in range(12)] + [(3, "w1 w2 w3"), (None, "w5 w5 w6"), (20, None), (21, "..."), (22, "q")]
    docs = []
    for i in range(60):
        t = text(rnd.randrange(0, 80))
        if i % 3 == 0:
            w = items[rnd.randrange(12)][1].split()
            k = rnd.randrange(0, max(1, len(w)))
            t += " ".join(w[k : k + rnd.randrange(5, 30)]).upper() + " " + text(5)
        docs.append((i, t))
    return docs + [(5, docs[5][1]), (None, "w1 w2 w3"), (61, None), (62, ""), (63, "w9 " * 30000)], items


def test_matches_brute_force(spark):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = D.brute(docs, items)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in D.report(d, b).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    many = [tuple(r) for r in D.report(d, b, block_chars=1500).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(many, key=key) == sorted(want, key=key)
    again = D.decontaminate(d.selectExpr("*", "1 as k1", "2 as n_words", "3 as row"), b, block_chars=300)
    assert again.columns == ["doc_id", "text", "k1", "n_words", "row"] and again.count() == sum(not w[-1] for w in want)


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 7)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.report(d, none))[0][:4] == (1, 3, 0, 0)
    assert D.report(d.limit(0), none).count() == 0
    b = spark.createDataFrame([(1, "a b", 1)], "item_id long, text string, doc_id int")
    assert D.decontaminate(d, none).columns == ["doc_id", "text", "n_words"]
    assert D.decontaminate(d, b).count() == 0
