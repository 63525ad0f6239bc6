import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    N, L = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3, **options):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item_id string, score int, terms int").repartition(parts)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in ranked_search.search(d, q, **options).collect()), key=str)


def corpus(rng, n, vocabulary=300):
    weight = 1 / np.arange(1, vocabulary + 1)
    words = [f"W{i}" if i % 3 else f"ñ{i}é" for i in range(vocabulary)]
    return [(int(i), " ".join(words[j] for j in rng.choice(vocabulary, int(rng.integers(1, 60)), p=weight / weight.sum()))) for i in range(n)]


ODD = [(9001, None), (9002, ""), (9003, " .,;\n"), (None, "w1 w2 W4"), (9004, "w4 " * 5000), (9005, "w4-w5_w7/w4\x00W8{w10}"), (9006, "ÑÉ ñé É3ñ"), (7, "w1 w50 w80"), (7, "w1 w50 w80"), (9007, "w1 w2 日本語 w4")]


def questions(docs, rng):
    picked = [(i, docs[int(rng.integers(len(docs)))][1]) for i in range(12)]
    return [*picked, picked[0], (3, "w1 w2"), (20, None), (21, "..."), (22, "absent words"), (None, "W4 w5 ñ0é"), (23, "w1"), (24, "É3ñ é3ñ ñé 日本語")]


@pytest.mark.parametrize("chunk", [40, 2048])
def test_against_brute_force(spark, monkeypatch, chunk):
    rng = np.random.default_rng(4)
    docs = corpus(rng, 700) + ODD
    docs += [(10_000 + i, docs[5][1]) for i in range(120)]  # ties
    items = questions(docs[:700], rng)
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    for k, parts in ((50, 3), (5, 1)):
        assert run(spark, docs, items, parts, k=k, block_docs=8) == brute(docs, items, k)


def test_item_blocks_narrow_matrices_and_split_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = corpus(rng, 150) + ODD
    items = questions(docs[:150], rng)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(ranked_search, "CHUNK_COUNTS", 50)
    monkeypatch.setattr(ranked_search, "MATRIX_BYTES", 3000)
    assert run(spark, docs, items, k=4, block_docs=4) == brute(docs, items, 4)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "w1")]) == [] == run(spark, [(1, "w1")], []) == run(spark, [(1, None)], [(1, "w1")]) == run(spark, [(1, "w1")], [(1, "?")])


def test_blocks_are_skipped_only_below_the_threshold():
    rng = np.random.default_rng(6)
    docs, wide = 600, 80
    value = np.where(rng.random((docs, wide)) < 0.15, rng.integers(1, 10**6, (docs, wide)), 0)
    value[:, 0] = rng.integers(1, 1000, docs)
    d, t = np.nonzero(value)
    weight = rng.integers(1, 9000, wide)
    index = ranked_search.ChunkIndex(d, t, value[d, t], docs, weight, 8)
    items = [np.sort(rng.choice(wide, 12, replace=False)) for _ in range(20)]
    exact = [value[:, q] @ weight[q] for q in items]
    for place in (0, 1, 10, 50):
        threshold = np.array([np.sort(s)[-1 - place] for s in exact])
        scored = 0
        for q, picked, score in index.search(items, threshold):
            assert (score == exact[q][picked]).all()
            assert set(np.flatnonzero(exact[q] >= threshold[q])) <= set(picked.tolist())
            scored += len(picked)
        assert scored < 0.9 * docs * len(items)
    for column in (0, 5):
        list_docs, first, summary = index.blocks(column, np.arange(len(index.present)))
        assert sorted(list_docs) == np.flatnonzero(value[:, index.present[column]]).tolist() and len(first) > 1
        for a, b, s in zip(first, [*first[1:], len(list_docs)], summary):
            assert (s == value[list_docs[a:b]][:, index.present].max(axis=0)).all()


def test_values_are_exact_beyond_64_bits():
    n = np.array([10**9, 5, 10**7])
    tf = np.array([3, 1, 10**6])
    N, L = 10**11, 10**14
    assert ranked_search.term_values(tf, n, N, L).tolist() == [10**9 * t // (1000 * t + 20 * (50 + 50 * x * N // L)) for t, x in zip(tf.tolist(), n.tolist())]


def test_terms_end_with_their_text():
    texts = ["ab", "cd", "", "é", "x y", "Z9"]
    from tidemark.llm.common import byte_view

    flat, offsets = byte_view(pa.array(texts, pa.large_string()))
    n, doc, place, tf = ranked_search.count_terms(flat, offsets, pa.array([b"ab", b"abcd", b"z9"], pa.large_binary()))
    assert n.tolist() == [1, 1, 0, 1, 2, 1] and list(zip(doc, place, tf)) == [(0, 0, 1), (5, 2, 1)]
