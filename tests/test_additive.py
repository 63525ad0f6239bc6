import numpy as np
from conftest import ts
from pyspark.sql import functions as F

from tidemark.operators import additive as N
from tidemark.operators import labels as L


def table(spark, n=400, seed=4):
    """Three classes; `x` shifts with the class, `w` is noise with gaps, `c` is constant, class 3 never occurs."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 3))
        x = 1e6 + y + float(rng.standard_normal())  # far from zero: naive squares would lose their digits
        w = None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(rng.standard_normal()) * (1 + y)
        rows.append((i, ts(f"2024-03-{1 + i * 20 // n:02d}T10:00:00"), y, x, w, 3.7))
    return rows, spark.createDataFrame(rows, "id int, t timestamp, y int, x double, w double, c double")


def brute(train, test, balanced=True, smoothing=1e-9):
    """Two-pass naive Bayes over (y, x, w, c) tuples."""
    ok = lambda v: v is not None and v == v
    classes = sorted({r[0] for r in train})
    out = []
    for row in test:
        logs = {}
        for k in classes:
            own = [r for r in train if r[0] == k]
            log = -np.log(len(classes)) if balanced else np.log(len(own) / len(train))
            for f in (1, 2, 3):
                pooled = [r[f] for r in train if ok(r[f])]
                if not ok(row[f]) or not pooled or np.ptp(pooled) == 0:
                    continue
                vals = [r[f] for r in own if ok(r[f])] or pooled
                v = np.var(vals) + smoothing * np.var(pooled)
                log -= (np.log(v) + (row[f] - np.mean(vals)) ** 2 / v) / 2
            logs[k] = log
        top = max(logs.values())
        total = sum(np.exp(v - top) for v in logs.values())
        out.append([np.exp(logs[k] - top) / total if k in logs else 0.0 for k in range(4)])
    return out


FEATURES = ["x", "w", "c"]


def test_holdout_equals_two_pass_naive_bayes(spark):
    rows, df = table(spark)
    got = {r.id: [r.q0, r.q1, r.q2, r.q3, r.pred] for r in N.holdout(df.filter("id < 300"), df.filter("id >= 300"), FEATURES, "y").collect()}
    want = brute([r[2:] for r in rows[:300]], [r[2:] for r in rows[300:]])
    for r, w in zip(rows[300:], want, strict=True):
        assert np.allclose(got[r[0]][:4], w, atol=1e-6) and got[r[0]][4] == int(np.argmax(w))


def test_every_fold_equals_a_model_of_its_own(spark):
    rows, df = table(spark)
    folds = L.walk_forward_folds(df, "t", n_folds=3, initial_days=5)
    got = N.out_of_fold(df, "t", folds, FEATURES, "y").collect()
    spans = folds.collect()
    assert len(got) == sum(f.test_start <= r[1].date() <= f.test_end for r in rows for f in spans) > 100
    by_id = {r[0]: r for r in rows}
    for f in spans:
        mine = [g for g in got if g.fold == f.fold]
        train = [r[2:] for r in rows if r[1].date() < f.train_before]
        want = brute(train, [by_id[g.id][2:] for g in mine])
        assert np.allclose([[g.q0, g.q1, g.q2, g.q3] for g in mine], want, atol=1e-6)


def test_search_reads_trials_from_the_same_sums(spark):
    rows, df = table(spark)
    folds = L.walk_forward_folds(df, "t", n_folds=2, initial_days=5)
    grid = [(1e-9, True), (0.5, False)]
    got = {r.trial: r for r in N.search(df, "t", folds, FEATURES, "y", grid).collect()}
    assert len(got) == 2 and got[1].smoothing == 0.5 and got[1].balanced is False
    for i, (s, b) in enumerate(grid):
        per_fold = []
        for f in folds.collect():
            test = [r[2:] for r in rows if f.test_start <= r[1].date() <= f.test_end]
            pred = np.argmax(brute([r[2:] for r in rows if r[1].date() < f.train_before], test, b, s), axis=1)
            y = np.array([r[0] for r in test])
            per_fold.append(np.mean([2 * np.sum((y == k) & (pred == k)) / (np.sum(y == k) + np.sum(pred == k)) for k in sorted(set(y))]))
        assert abs(got[i].value - np.mean(per_fold)) < 1e-9


def test_defined_cases(spark):
    _, df = table(spark, 60)
    assert N.holdout(df.limit(0), df, FEATURES, "y").filter("pred IS NOT NULL OR q0 IS NOT NULL").count() == 0  # no training rows
    assert N.holdout(df, df.limit(0), FEATURES, "y").count() == 0
    unlabelled = df.withColumn("y", F.when(F.col("y") == 1, 1))
    assert {(r.q0, r.q1, r.pred) for r in N.holdout(unlabelled, df, FEATURES, "y").collect()} == {(0.0, 1.0, 1)}  # one class alone
    blank = df.select("id", "t", "y", *[F.lit(None).cast("double").alias(f) for f in FEATURES])
    assert {(round(r.q0, 9), r.pred) for r in N.holdout(df, blank, FEATURES, "y").collect()} == {(round(1 / 3, 9), 0)}  # a tie of priors
    # A class whose rows lack a feature takes the pooled values: the feature then tells it from nothing but the others' spread.
    lacking = df.withColumn("x", F.when(F.col("y") != 2, F.col("x")))
    assert N.holdout(lacking, df, ["x"], "y").filter("q2 > 0 AND q2 < 1").count() == 60
