import random

from test_ngram_join import grams
from tidemark.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, hits int"


def data(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["É,", "ab.", "ÀB"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 40, 80])))) for i in range(40)]
    items += [(100, items[5][1]), (101, None), (102, ""), (None, items[7][1])]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 50, 400, 3000]))
        for _ in range(rng.choice([0, 1, 2])):
            w = (rng.choice(items[:40])[1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = w
        t = " ".join(words)
        docs.append((i, t.upper() if rng.random() < 0.2 else t.replace(" ", "\n\t", 3)))
    return docs + [(7, docs[7][1]), (None, docs[3][1]), (201, None), (202, items[0][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    have, need = [grams(t) for _, t in docs], [grams(t) for _, t in items]
    want = sorted((str(docs[d][0]), str(items[i][0]), len(n), len(n & h)) for d, h in enumerate(have) for i, n in enumerate(need) if n and 10 * len(n & h) >= 8 * len(n))
    for block in (20_000, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        got = decontaminate.matches(df, bench).collect()
        assert sorted((str(r.doc_id), str(r.item_id), r.n_item, r.n_found) for r in got) == want
    assert len(want) > 50
    clean = decontaminate.screen(df, bench, name="_h").where("size(_h) = 0").drop("_h")
    assert clean.columns == df.columns
    bad = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if str(d) not in bad)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(df, none).count() == 0
    assert decontaminate.screen(df, none, name="_h").count() == 1
    assert decontaminate.matches(df.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
