import numpy as np
import pytest

from tidemark.llm import collision_ann


def brute(rows, asked, k):
    out = []
    v = {}
    for i, x in rows:
        v.setdefault(i, []).append(np.array(x, float))
    for q in sorted(asked):
        x = min((tuple(map(float, y)) for y in v[q]))
        scored = sorted((-float((np.array(x) * y).sum()), i) for i, ys in v.items() if i != q for y in ys)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None] if not norms else 4
    x = x.astype(np.float32)
    x[50:90] = x[40]  # equal vectors: ties go to the smaller id
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, r, 1, 2) for i, r in rows], "vec_id long, embedding array<float>, shard int, block int").repartition(3)
    got = collision_ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=1000, block_queries=50).collect()
    want = brute(rows, range(0, 4000, 20), 20)
    true = {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want)
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)
    for r in got:
        assert r.score == pytest.approx(float((x[r.query_id].astype(float) * x[r.vec_id].astype(float)).sum()), abs=1e-15)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for rows_ in by.values():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and [r[1:] for r in rows_] == sorted(r[1:] for r in rows_)
    first = sorted(by[40])
    assert [r[2] for r in first][:5] == [50, 51, 52, 53, 54] or norms


def test_odd_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (40, [0.0, 0.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (20, [3.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in collision_ann.nearest(df, df.where("vec_id % 20 = 0")).collect())
    good = [(i, x) for i, x in rows if i in (0, 20, 1, 8)]
    assert got == brute(good, [0, 20], 20)
    assert collision_ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert collision_ann.nearest(df, df.where("vec_id = 40")).count() == 0


@pytest.mark.parametrize("norms", ["one long vector", "lognormal"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(0.5 * rng.standard_normal(4000))[:, None] if norms == "lognormal" else np.where(np.arange(4000) == 7, 5, 1)[:, None]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collision_ann.nearest(df, df.where("vec_id % 40 = 0")).collect()
    want = brute(rows, range(0, 4000, 40), 20)
    assert len(got) == len(want)
    true = {(q, i) for q, _, i, _ in want}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)


def test_bands_hold_every_row_once_and_small_ones_are_exact():
    rng = np.random.default_rng(6)
    norms = np.concatenate((np.ones(2000), np.exp(rng.standard_normal(1500))))
    cut = collision_ann.bands(norms)
    assert sorted(np.concatenate(cut)) == list(range(3500))
    for band in cut:
        assert len(band) <= collision_ann.EXACT_ROWS or norms[band].max() <= norms[band].min() * collision_ann.NORM_RATIO * (1 + 1e-12)
