import random
import re

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, rank int, size string"


def waterfill(sizes):
    """Targets by plain rounds; sizes in order of source."""
    total, weight = sum(sizes), [1 + i % 3 for i in range(len(sizes))]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while open_:
        share = {i: rest * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            rest -= 3 * sizes[i]
        open_ -= over
    return target


def corpus(seed, n=3000):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "tiny", "zero"]
    rows = []
    for i in range(n):
        s = rng.choices(sources, [30, 5, 5, 10, 8, 1, 1])[0]
        k = 0 if s == "zero" else int(rng.expovariate(1 / 40)) if s != "tiny" else 1
        rows.append((i, " ".join(["w"] * k) if k or rng.random() < 0.5 else None, s))
    return rows + [(90_005, "repeated row", "a"), (90_005, "repeated row", "a"), (None, "no id", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], SCHEMA).repartition(7)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, waterfill([size[s] for s in order])))
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    source = {d: s for d, _, s in rows if d is not None}
    taken = {}
    for r in got:
        s = source.get(r.doc_id, "b")
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    longest = max(r.size for r in got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * longest
    again = mixing.plan(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_whole_rows(spark):
    rows = corpus(4, 300)
    df = spark.createDataFrame([(d, t, s, i, "x") for i, (d, t, s) in enumerate(rows)], SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    copies = {}
    for r in out.collect():
        copies[r["rank"]] = copies.get(r["rank"], 0) + 1
        assert rows[r["rank"]] == (r.doc_id, r.text, r.source)
    assert max(copies.values()) <= 3
    planned = sorted(r.copies for r in mixing.plan(df).collect() if r.copies)
    assert sorted(copies.values()) == planned


def test_empty_table_and_no_words(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(df).count() == 0 and mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, "", "a", 1, ""), (2, None, None, 1, "")], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.plan(df).collect()] == [(0, 0.0, 0)] * 2


def test_hot_source_spreads(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'w w' as text", "'one' as source")
    rows = mixing.ranked(df, "source", [df.doc_id], 8)
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, 20_001))


def test_a_column_named_like_the_size_is_no_input(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "x"), (3, "e f", "y")], "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in mixing.plan(df).collect())
    for name in ("_size", "_SIZE"):
        extra = df.selectExpr("*", f"1000L AS {name}")
        assert sorted(tuple(r) for r in mixing.plan(extra).collect()) == want
        assert mixing.mix(extra).columns == extra.columns
