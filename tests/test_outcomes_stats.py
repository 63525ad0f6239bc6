import numpy as np
import pytest
from conftest import ts
from pyspark.sql import functions as F

from tidemark.functions.distributions import t_two_sided_p
from tidemark.operators import labels as L
from tidemark.operators import outcomes as O
from tidemark.operators import stats as S


def bars(spark):
    prices = [(10, 11, 9.5, 10.5), (10.5, 12, 10, 11), (8, 8.5, 7, 8), (9, 13, 8, 12), (12, 12.5, 11, 12)]
    rows = [("X", i + 1, ts(f"2024-01-01T10:0{i}:00"), *map(float, p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "ticker string, idx long, ts timestamp, open double, high double, low double, close double")


def exits(spark, rows):
    t = spark.createDataFrame([(i, "X", 1, 5, 10.0, 12.0, *r) for i, r in enumerate(rows)], "id int, ticker string, entry_idx long, exit_idx long, entry_price double, exit_price double, direction string, stop_dist double")
    return [(r.stopped, r.exit_fill) for r in O.first_touch_exit(t, bars(spark), block=2).orderBy("id").collect()]


def test_first_touch_exit(spark):
    got = exits(spark, [("long", 0.5), ("long", 1.0), ("short", 2.5), ("long", None), ("long", float("nan")), ("long", 9.0), ("long", -1.0), ("short", 1.5)])
    assert got == [(True, 9.5), (True, 8.0), (True, 12.5), (False, 12.0), (False, 12.0), (False, 12.0), (False, 12.0), (True, 11.5)]


def test_short_circuit_variant_misses_later_stops(spark):
    t = spark.createDataFrame([(1, "X", 1, 5, 9.0), (2, "X", 1, 5, 9.7), (3, "X", 3, 5, 9.0), (4, "X", 1, 5, None)], "id int, ticker string, entry_idx long, exit_idx long, stop_price double")
    got = {r.id: (r.stopped, r.exit_price) for r in O.short_circuit_exit(t, bars(spark), block=2).collect()}
    assert got == {1: (False, 12.0), 2: (True, 9.7), 3: (True, 9.0), 4: (False, 12.0)}


def test_paths_of_any_length_and_equal_trades(spark):
    """The only touch is 300 bars after the entry, far beyond one block."""
    rows = [("X", i, ts("2024-01-01T10:00:00"), 10.0, 11.0, 9.0 if i != 301 else 5.0, 10.0) for i in range(1, 420)]
    b = spark.createDataFrame(rows, "ticker string, idx long, ts timestamp, open double, high double, low double, close double")
    t = spark.createDataFrame([("X", 1, 400, 10.0, 12.0, "long", 3.0), ("X", 1, 400, 10.0, 12.0, "long", 3.0), ("X", 1, 300, 10.0, 12.0, "long", 3.0)], "ticker string, entry_idx long, exit_idx long, entry_price double, exit_price double, direction string, stop_dist double")
    for block in (7, 128):
        got = sorted((r.exit_idx, r.stopped, r.exit_fill) for r in O.first_touch_exit(t, b, block).collect())
        assert got == [(300, False, 12.0), (400, True, 7.0), (400, True, 7.0)]
    s = t.select("ticker", "entry_idx", "exit_idx", F.lit(5.5).alias("stop_price"))
    assert [r.stopped for r in O.short_circuit_exit(s, b).collect()] == [False] * 3


def test_decide_order_ties_and_suppression(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1, 0.4, 0.4), (2, 0.5, 0.1, 0.3, 0.1), (3, 0.25, 0.25, 0.25, 0.25)], "id int, p0 double, p1 double, p2 double, p3 double")
    probs, thr = ["p0", "p1", "p2", "p3"], {"Buy": 0.4, "Strong Buy": 0.4, "Sell": 0.45}
    got = {r.id: (r.status, r.class_name) for r in L.decide(df, probs, thr).collect()}
    assert got == {1: ("fired", "Strong Buy"), 2: ("silent", "Sell"), 3: ("silent", "Sell")}
    assert L.decide(df, probs, thr, suppressed=()).filter("id = 2").first().status == "fired"


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (1.79, 29, 0.08391236), (0.0, 5, 1.0), (12.706, 1, 0.0500005)])
def test_student_p(t, df, p):
    assert abs(t_two_sided_p(t, df) - p) < 2e-5


def test_weighted_difference_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    e = [(f"m{rng.integers(6)}", float(rng.normal(0.3))) for _ in range(60)]
    p = [(f"m{rng.integers(8)}", float(rng.normal()), float(rng.uniform(0.1, 2))) for _ in range(90)]
    r = S.weighted_diff_test(spark.createDataFrame(e, "month string, y double"), spark.createDataFrame(p, "month string, y double, w double"), [], "month", "y", "w", 50).first()
    y = np.array([x[1] for x in e] + [x[1] for x in p])
    w = np.array([1.0] * 60 + [x[2] for x in p])
    x = np.column_stack([np.ones(150), [1.0] * 60 + [0.0] * 90])
    m = np.array([a[0] for a in e] + [a[0] for a in p])
    inv = np.linalg.inv(x.T @ (x * w[:, None]))
    b = inv @ (x.T @ (w * y))
    u = y - x @ b
    meat = sum(np.outer(s, s) for s in (x[m == g].T @ (w * u)[m == g] for g in np.unique(m)))
    g = len(np.unique(m))
    se = np.sqrt((g / (g - 1) * inv @ meat @ inv)[1, 1])
    assert r.G == g and abs(r["diff"] - b[1]) < 1e-9 and abs(r.se - se) < 1e-9 and abs(r.p - t_two_sided_p(b[1] / se, g - 1)) < 1e-9


def test_zero_variance_one_cluster_and_thin(spark):
    df = spark.createDataFrame([("a", "d1", 1.0), ("a", "d2", 1.0), ("b", "d1", 2.0)], "g string, day string, x double")
    got = {r.g: r for r in S.cluster_stats(df, ["g"], "day", "x").collect()}
    assert got["a"].t is None and got["b"].t is None and got["a"].cluster_mean == 1.0
    s = {r.g: r for r in S.summarize(df, ["g"], "day", "x", 20).collect()}
    assert s["a"].thin and s["a"].lo == s["a"].hi == 1.0


def test_bootstrap_is_the_same_however_rows_are_partitioned(spark):
    df = spark.range(200).select((F.col("id") % 9).alias("day"), F.sin("id").alias("x"))
    a = S.cluster_bootstrap(df, [], "day", "x", 50).first()
    b = S.cluster_bootstrap(df.repartition(7, "x"), [], "day", "x", 50).first()
    assert abs(a.lo - b.lo) < 1e-12 and abs(a.hi - b.hi) < 1e-12


def test_cell_mix_weights_keep_horizons_apart(spark):
    pop = spark.createDataFrame([("a", 5, "m1", 1.0), ("a", 5, "m2", 3.0), ("b", 5, "m1", 2.0), ("a", 60, "m1", 7.0)], "ticker string, h int, month string, y double")
    ev = spark.createDataFrame([("all", 5, "a", "m1", 0.0), ("all", 5, "b", "m1", 0.0), ("all", 60, "a", "m1", 0.0), ("all", 60, "a", "m2", 0.0)], "cell string, h int, ticker string, month string, y double")
    got = S.cell_mix_weights(pop, ev, ["cell", "h"], "month", "y", shared=["h"])
    assert sorted((r.h, r.ticker, r.month, r.w, r.y) for r in got.collect()) == [(5, "a", "m1", 0.5, 1.0), (5, "a", "m2", 0.5, 3.0), (5, "b", "m1", 1.0, 2.0), (60, "a", "m1", 2.0, 7.0)]


def test_cells_meet_the_population_at_every_horizon():
    from tidemark.plans import catalog

    sql = catalog.ORACLES["h9_cells_difference_horizons"]
    assert "h9_cells_difference_horizons" in catalog.QUERIES and all(f"adj_ret_{h}d AS y" in sql or f"THEN p.adj_ret_{h}d" in sql or f"ELSE p.adj_ret_{h}d" in sql for h in (5, 20, 60))


def test_random_ticker_control_of_groups(spark):
    sig = spark.createDataFrame([("all", 1, "a", "d1", 1), ("all", 2, "b", "d1", 1), ("fired", 2, "b", "d1", 1), ("all", 3, "a", "d2", 2)], "grp string, signal_id int, ticker string, day string, t0 int")
    rets = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0)], "t0 int, ticker string, adj double")  # window 2 has no other ticker
    got = S.random_ticker_control(sig, rets, ["t0"], 3, "7", by=["grp"]).collect()
    assert sorted((r.grp, r.b, r.draw_mean) for r in got) == [("all", b, 2.0) for b in range(3)] + [("fired", b, 1.0) for b in range(3)]


def test_random_ticker_draws_equal_a_loop(spark):
    from hashlib import md5

    tickers, n = list("abcde"), 40
    rng = np.random.default_rng(3)
    adj = {(w, t): None if (w + i) % 7 == 0 else float(rng.integers(-9, 9)) for w in range(6) for i, t in enumerate(tickers)}
    sig = [(i, tickers[i % 5], f"d{i % 3}", i % 6) for i in range(60)]
    want = []
    for b in range(n):
        days = {}
        for i, t, d, w in sig:
            v = [adj[w, x] for x in tickers if x != t and adj[w, x] is not None]
            days.setdefault(d, []).append(v[int(md5(f"7|{b}|{i}".encode()).hexdigest()[:8], 16) % len(v)])
        want.append(np.mean([np.mean(x) for x in days.values()]))
    s = spark.createDataFrame(sig, "signal_id int, ticker string, day string, t0 int")
    r = spark.createDataFrame([(w, t, x) for (w, t), x in adj.items()], "t0 int, ticker string, adj double")
    got = {x.b: x.draw_mean for x in S.random_ticker_control(s, r, ["t0"], n, "7").collect()}
    assert np.allclose([got[b] for b in range(n)], want) and len(got) == n


def test_secrets_stay_out_of_plans(spark):
    from tidemark.operators.clean import redact

    df = spark.createDataFrame([("key=s3cr3tvalue, tok",), (None,)], "text string")
    out = df.select(redact("text", {"KEY": "s3cr3tvalue", "EMPTY": "", "TOK": "tok"}).alias("text"))
    assert [r.text for r in out.collect()] == ["key=***REDACTED_KEY***, ***REDACTED_TOK***", None]
    assert "s3cr3tvalue" not in out._jdf.queryExecution().toString()
    assert redact("text", {"EMPTY": ""}) is not None


def test_drawdown_does_not_depend_on_the_block_width(spark):
    rng = np.random.default_rng(8)
    rows = [(g, ts(f"2024-03-04T{int(h):02d}:{int(m):02d}:00"), i, float(x)) for i, (g, h, m, x) in enumerate(zip(rng.choice(["A", "B"], 400), rng.integers(9, 12, 400), rng.integers(0, 60, 400), rng.standard_normal(400)))]
    df = spark.createDataFrame(rows, "g string, t timestamp, i int, x double")
    want = {}
    for g in "AB":
        c = np.cumsum([r[3] for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == g])
        want[g] = (np.maximum.accumulate(c) - c).max()
    for width in (60_000_000, 3_600_000_000, 86_400_000_000):
        got = {r.g: r.max_drawdown for r in O.max_drawdown(df, ["g"], "t", "i", "x", width).collect()}
        assert all(abs(got[g] - want[g]) < 1e-9 for g in want)


def resampled(cells, n_boot, seed, stat):
    """2.5/97.5 percentiles of `stat` over hash-drawn resamples of a group's month rows (in order), by a loop."""
    from hashlib import md5

    n = len(cells)
    draws = [stat([cells[int(md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]) for b in range(n_boot)]
    return np.percentile([x for x in draws if x is not None], [2.5, 97.5])


def test_draws_in_blocks_equal_a_loop(spark):
    """More draws than a block holds, groups of unequal size; a null group has no draws."""
    rows = [(g, m, float((7 * g + 3 * m) % 11), m + 1) for g, n in ((1, 5), (2, 1)) for m in range(n)] + [(None, 0, 1.0, 1)]
    cl = spark.createDataFrame(rows[::-1], "g int, m int, c_sum double, c_n int")
    got = S.bootstrap_draws(cl, ["g"], "m", 2 * S.DRAW_BLOCK + 7, "s").groupBy("g").agg(F.count_distinct("b").alias("n"), F.max("b").alias("b"), F.sum("c_sum").alias("x"), F.count("*").alias("k")).collect()
    assert sorted((r.g, r.n, r.b, r.k) for r in got) == [(1, 207, 206, 5 * 207), (2, 207, 206, 207)]
    total = []
    resampled([r for r in rows if r[0] == 1], 207, "s", lambda c: total.append(sum(x[2] for x in c)) or 0)
    assert {r.g: r.x for r in got} == {1: sum(total), 2: 207 * rows[5][2]}


def study_rows(spark):
    import datetime as dt

    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], dt.date(1995, 1 + i % 6, 3 + i % 9), (5, 60)[i // 36], float(rng.integers(-40, 60)), i % 3 == 0, "r", "s", True) for i in range(72)]
    scored = spark.createDataFrame(rows, "ticker string, filing_date date, h int, adj_ret double, is_10b5_1 boolean, role string, size_bucket string, is_cluster boolean")
    return rows, scored


def test_cells_versus_zero_resample_10000_times(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.plans import statistics_queries as Q

    rows, scored = study_rows(spark)
    monkeypatch.setattr(Q, "scored", lambda v, ev=None: scored)
    got = {(r.cell, r.h): (r.lo, r.hi) for r in Q.h9z(SimpleNamespace(keep=lambda df: df)).collect()}
    assert len(got) == 12
    for h in (5, 60):
        months = {}
        for r in rows:
            if r[2] == h:
                months.setdefault(r[1].month, []).append(r[3])
        cells = [(sum(months[m]), len(months[m])) for m in sorted(months)]
        assert np.allclose(got["all", h], resampled(cells, 10000, "42", lambda c: sum(x[0] for x in c) / sum(x[1] for x in c)), atol=1e-5)


def test_cells_difference_horizons_resample_10000_times(spark, monkeypatch):
    from tidemark.plans import statistics_queries as Q

    rows, scored = study_rows(spark)
    pop = [(t, h, f"1995-{m:02d}", float((m * m + 3 * h + ord(t)) % 17)) for t in "ab" for h in (5, 60) for m in range(1, 7)]
    monkeypatch.setattr(Q, "scored", lambda v, ev=None: scored)
    monkeypatch.setattr(Q, "both", lambda v: (None, None, None))
    monkeypatch.setattr(Q, "population_horizons", lambda v, ev: spark.createDataFrame(pop, "ticker string, h int, month string, y double"))
    got = {(r.cell, r.h): (r.lo, r.hi) for r in Q.h9dh(None).collect()}
    assert len(got) == 12
    for h in (5, 60):
        n = {t: sum(r[0] == t and r[2] == h for r in rows) for t in "ab"}
        cells = []
        for m in range(1, 7):
            e = [r[3] for r in rows if r[2] == h and r[1].month == m]
            p = [(n[t] / 6, y) for t, k, at, y in pop if k == h and at == f"1995-{m:02d}"]
            cells.append((sum(e), len(e), sum(w * y for w, y in p), sum(w for w, _ in p)))
        def stat(c):
            ey, ew, py, pw = (sum(x[k] for x in c) for k in range(4))
            return ey / ew - py / pw
        assert np.allclose(got["all", h], resampled(cells, 10000, "7", stat), atol=1e-5)
