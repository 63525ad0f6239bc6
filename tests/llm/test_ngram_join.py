import random
import re

import pytest

from tidemark.llm import ngram_join

SCHEMA = "doc_id long, text string, rows string, name string, chunk int"  # extra columns whose names the operator uses


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = set()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                links.add((j, i))
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str), links, sets


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(400)]
    common = " ".join(rng.choices(vocabulary, k=60))
    bases = [rng.choices(vocabulary, k=rng.randint(8, 150)) for _ in range(15)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        out.append((i * 3 + 1, text + " " + common if rng.random() < 0.3 else text.upper() if rng.random() < 0.2 else text))
    return out + [(5, None), (8, ""), (11, " \n "), (None, out[0][1]), (None, "only null ids have these six words"), (14, "a b"), (17, "A  b"), (17, "A  b"), (20, "a b c")]


@pytest.mark.parametrize("seed,block,chunk", [(1, 32 << 20, 4 << 20), (2, 6000, 3000)])
def test_against_brute_force(spark, seed, block, chunk):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)
    want, links, sets = brute(rows)
    got = ngram_join.classes(df, block_bytes=block, chunk_bytes=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == want

    members, pairs = ngram_join.ngram_join(df, all_pairs=True, block_bytes=block, chunk_bytes=chunk)
    name_of = {}
    for r in members.collect():
        for i, (d, _) in enumerate(rows):
            if d == r.doc_id and len(sets[i]) == r.n_shingles:
                name_of[frozenset(sets[i])] = r.name
    wanted = {tuple(sorted((name_of[frozenset(sets[i])], name_of[frozenset(sets[j])]))) for i, j in links if sets[i] != sets[j]}
    assert {tuple(sorted(p)) for p in pairs.collect()} == wanted


def test_distinct_documents_keeps_all_columns(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, f"r{i}", None, i) for i, (d, t) in enumerate(rows)], SCHEMA)
    got = ngram_join.distinct_documents(df, chunk_bytes=3000)
    assert got.columns == df.columns
    kept = got.collect()
    want = brute(rows)[0]
    classes = {c for d, n, c in want if n and c is not None}
    assert sorted(r.doc_id for r in kept if grams(r.text) and r.doc_id is not None) == sorted(classes)
    assert sum(r.doc_id is None for r in kept) == 1  # the class of null ids alone
    assert sorted(r.doc_id for r in kept if not grams(r.text)) == [5, 8, 11]
    by_id = {(d, t): f"r{i}" for i, (d, t) in enumerate(rows) if d != 17}
    assert all(by_id[r.doc_id, r.text] == r.rows for r in kept if r.doc_id != 17)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join.classes(df).count() == 0
    assert ngram_join.distinct_documents(df).count() == 0


def test_very_long_and_equal_texts(spark):
    long = " ".join(f"w{i % 977}x{i // 50}" for i in range(60_000))
    df = spark.createDataFrame([(i, long) for i in (4, 2, 9)] + [(1, long + " and one more word")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.classes(df).collect()} == {1}
