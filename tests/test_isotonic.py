import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import isotonic as I
from tidemark.operators import models as M


def brute(pairs):
    """Max over starts of the least mean up to any later end, per distinct score."""
    xs = sorted({x for x, _ in pairs})
    s = [sum(y for x, y in pairs if x == v) for v in xs]
    w = [sum(x == v for x, _ in pairs) for v in xs]
    return {
        v: max(min(sum(s[a : b + 1]) / sum(w[a : b + 1]) for b in range(q, len(xs))) for a in range(q + 1)) for q, v in enumerate(xs)
    }


def test_steps_equal_the_closed_form_for_any_cut(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), 0.0) for i in range(240)]
    # A third of the scores are one value; the rest follow the label loosely.
    rows = [(i, y, 0.5 if i % 3 == 0 else round(float(np.clip(0.3 * y + rng.standard_normal() * 0.3, 0, 1)), 2)) for i, y, _ in rows]
    df = spark.createDataFrame(rows, "id int, y int, a0 double").withColumn("a1", 1 - F.col("a0"))
    for parts in (2, 16, 64):
        steps = I.fit(df, "y", ["a0", "a1"], parts=parts).collect()
        for k, x in ((0, lambda r: r[2]), (1, lambda r: 1 - r[2])):
            want = brute([(x(r), int(r[1] == k)) for r in rows])
            mine = [s for s in steps if s.class_id == k]
            got = {v: next(s.y for s in mine if s.x_lo <= v <= s.x_hi) for v in want}
            assert got == want and sum(s.w for s in mine) == 240
            assert len({s.y for s in mine}) == len(mine)  # steps of equal mean are one


def test_applied_map_equals_mllib_between_and_beyond_steps(spark):
    rng = np.random.default_rng(9)
    rows = [(i, y := int(rng.integers(0, 2)), float(0.25 + 0.5 * np.clip(0.5 * y + 0.3 * rng.standard_normal(), 0, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, a0 double").withColumn("a1", 1 - F.col("a0"))
    new = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.linspace(-0.5, 1.5, 201))], "id int, a0 double").withColumn("a1", 1 - F.col("a0"))
    a = ["a0", "a1"]
    want = {r.id: (r.c0, r.c1) for r in M.calibrate(new, M.fit_isotonic(df, "y", a), a).collect()}
    got = {r.id: (r.c0, r.c1) for r in I.apply(new, I.fit(df, "y", a), a, "id").collect()}
    assert len(got) == 201 and np.allclose([got[i] for i in range(201)], [want[i] for i in range(201)], atol=1e-12)


def test_defined_cases(spark):
    schema = "id int, y int, a0 double, a1 double"
    df = spark.createDataFrame([(1, 0, 0.2, 0.8), (2, 1, 0.6, 0.4), (3, None, 0.9, 0.1), (4, 0, None, 0.3), (5, 1, float("nan"), 0.7)], schema)
    steps = I.fit(df, "y", ["a0", "a1"])
    assert steps.agg(F.sum("w")).first()[0] == 2 + 4  # null labels, null and NaN scores take no part
    got = {r.id: (r.c0, r.c1) for r in I.apply(df, steps, ["a0", "a1"], "id").collect()}
    assert len(got) == 5 and got[4] == (None, None) and got[5] == (None, None)
    assert all(abs(sum(got[i]) - 1) < 1e-12 or sum(got[i]) == 0 for i in (1, 2, 3))
    assert I.apply(df, steps.limit(0), ["a0", "a1"], "id").filter("c0 IS NOT NULL").count() == 0
    assert I.fit(df.limit(0), "y", ["a0", "a1"]).count() == 0
    flat = spark.createDataFrame([(1, 2, 0.5, 0.5)], schema)  # neither class occurs: all maps give zero
    assert I.apply(flat, I.fit(flat, "y", ["a0", "a1"]), ["a0", "a1"], "id").first().c0 == 0.0
