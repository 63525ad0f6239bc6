"""Steps that must not grow faster than their input: plans without grids or wide shuffles, same results as plain loops."""

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.scan import exact_quantiles
from tidemark.operators import align as A
from tidemark.operators import features as E
from tidemark.operators import filings as I
from tidemark.operators import stats as S
from tidemark.operators import text as X
from tidemark.plans import catalog

D0 = dt.date(1969, 11, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_peer_momentum_without_a_grid_of_tickers_and_dates(spark):
    # Long gaps around 1970, a ticker that ends early, one in two sectors, one with an outlier, one not in the universe.
    days = {"A": range(0, 40), "B": [0, 1, 2, 3, 4, 5, 6, 130, 300], "C": range(3, 12), "D": range(10, 200, 3), "Z": range(0, 50)}
    close = {(t, n): 1e17 if (t, n) == ("D", 40) else 100.0 + (7 * n + len(days[t])) % 23 for t, ns in days.items() for n in ns}
    daily = spark.createDataFrame([(t, day(n), c) for (t, n), c in close.items()], "ticker string, d date, c double")
    names = {"X": ["A", "B", "D"], "Y": ["B", "C", "none"]}
    universe = spark.createDataFrame([(s, t) for s, ts in names.items() for t in ts] + [("X", "A")], "sector string, ticker string")
    wanted = [("X", n) for n in range(0, 330, 7)] + [("Y", n) for n in (0, 6, 7, 9, 11, 64, 95, 96, 131, 320)]
    dates = spark.createDataFrame([(s, day(n)) for s, n in wanted] + [("X", None), ("absent", day(9))], "sector string, date date")

    def last(t, n):
        before = sorted(k for k in days.get(t, ()) if k < n)
        return close[t, before[-1]] / close[t, before[-6]] - 1 if len(before) >= 6 else None

    want = {}
    for s, n in wanted:
        moms = [m for t in names[s] if (m := last(t, n)) is not None]
        want[s, day(n)] = sum(moms) / len(moms) if moms else None
    df = E.peer_momentum(universe, daily, dates)
    got = {(r.sector, r.date): r.peer_mom for r in df.collect()}
    assert got.pop(("X", None)) is None and set(got) == set(want)
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or abs(got[k] - w) <= 1e-12 * max(1.0, abs(w))), k
    assert "collect_set" not in plan(df)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def closes(spark):
    # Gaps of a month, a ticker that ends, one with a single day; enough days for every horizon.
    rows = [(t, n + (40 if n > cut else 0), 50.0 + (n * k) % 17) for t, k, cut, last in (("A", 3, 30, 60), ("B", 5, 4, 12), ("C", 7, 99, 1)) for n in range(last)]
    return spark.createDataFrame([(t, day(n), c) for t, n, c in rows], "ticker string, d date, c double")


def test_exits_come_with_the_entry(spark):
    daily = closes(spark)
    points = spark.createDataFrame([(t, day(n)) for t in "ABCZ" for n in range(-2, 110, 3)], "ticker string, a date")
    plain, rich = A.daily_path(daily), A.daily_path(daily, horizons=[2, 5, 20])
    cols = ["ticker", "a", "h", "entry_date", "entry_price", "exit_date", "exit_price", "ret", "truncated"]
    old = A.study_exits(A.study_entries(points, plain, "a"), plain, [2, 5, 20]).select(*cols)
    new = A.study_exits(A.study_entries(points, rich, "a"), rich, [2, 5, 20]).select(*cols)
    got = sorted(map(tuple, new.collect()))
    assert got == sorted(map(tuple, old.collect())) and len({r[8] for r in got}) == 2
    assert plan(new).count("Join") < plan(old).count("Join")


def test_daily_rows_move_once_by_ticker(spark):
    daily = closes(spark).groupBy("ticker", "d").agg(F.max("c").alias("c"))
    bench = daily.groupBy("d").agg(F.avg("c").alias("c"))
    events = spark.createDataFrame([("A", day(10)), ("A", day(10)), ("B", day(3)), ("Z", day(3))], "ticker string, e date")
    pop = E.population_returns(daily, bench, [2], window=5, min_days=2)
    flagged = A.eligible_days(pop, events, "d", "e", 2)
    # By ticker alone go the days, once, and the marks; no join moves the days again.
    text = executed(flagged)
    assert len(re.findall(r"hashpartitioning\(ticker#\d+, \d+\)", text)) == 2 and "SortMergeJoin" not in text
    got = {(r.ticker, r.d): r.eligible for r in flagged.collect()}
    near = {("A", n) for n in range(8, 13)} | {("B", n) for n in range(1, 5)}
    assert len(got) == daily.count() and {k for k, ok in got.items() if not ok} == {(t, day(n)) for t, n in near}


def test_benchmark_between_dates(spark):
    bench = spark.createDataFrame([(day(n), 100.0 + n * n) for n in (0, 1, 4, 9)] + [(None, 7.0)], "d date, c double")
    days = [-3, 0, 1, 2, 4, 5, 9, 12, None]
    spans = [(i, None if a is None else day(a), None if z is None else day(z)) for i, (a, z) in enumerate((a, z) for a in days for z in days)]
    df = spark.createDataFrame([*spans, spans[0]], "id int, a date, z date")
    bars = {day(n): 100.0 + n * n for n in (0, 1, 4, 9)}

    def value(a, z):
        inside = [] if a is None or z is None else sorted(d for d in bars if a <= d <= z)
        return bars[inside[-1]] / bars[inside[0]] - 1 if len(inside) > 1 else None

    got = A.bench_between(df, bench, "a", "z")
    rows = got.collect()
    assert len(rows) == len(spans) + 1 and got.columns == ["id", "a", "z", "bench_ret"]
    assert all(r.bench_ret == value(r.a, r.z) for r in rows)
    assert "SortMergeJoin" not in executed(got)


def test_month_sums_are_computed_once(spark):
    events = spark.createDataFrame([("x", "A", f"m{i % 4}", i / 7) for i in range(20)], "cell string, ticker string, month string, y double")
    pop = spark.createDataFrame([("A", f"m{i % 5}", i / 9) for i in range(30)], "ticker string, month string, y double")
    p = S.cell_mix_weights(pop, events, ["cell"], "month", "y")
    df = S.weighted_diff_test(events, p, ["cell"], "month", "y", "w", 20)
    assert df.count() == 1 and "LocalRelation" not in plan(df) and plan(df).count("LogicalRDD") >= 2
    w = S.ticker_mix_weights(pop, events.filter("month < 'm2'"))
    assert abs(sum(r.w for r in w.collect()) - 10) < 1e-9 and plan(w).count("Join") == 1


def test_texts_are_not_dealt_by_ticker(spark):
    rows = [(i, "A" if i % 9 else None, "Acme gains" if i % 2 else "Other", "about Acme" if i % 3 else "none") for i in range(36)]
    news = spark.createDataFrame(rows, "id int, ticker string, headline string, summary string")
    patterns = X.matchers(spark.createDataFrame([("A", "Acme")], "ticker string, name string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tagged = X.relevance_tier(news, patterns)
        assert "hashpartitioning(ticker" not in executed(tagged)
        got = {r.id: r.relevance_tier for r in tagged.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: 3 if t is None else 1 if "Acme" in h else 2 if "Acme" in s else 3 for i, t, h, s in rows}


def test_landed_items_of_a_ticker_come_in_pages(spark, tmp_path):
    ids = [0, 3, 9_999, 10_000, 25_000, 25_001]
    docs = spark.createDataFrame([(i, f"Head {i}. Rest", "en", "s", 12) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 12, 0, i % 60), i, "click", 1.0, "{}") for i in ids], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES["a1_news_items"](spark, str(tmp_path))
    assert sorted((r.id, r.ticker) for r in df.collect()) == [(i, "click") for i in ids]
    assert len(df.inputFiles()) == 3


def test_windows_across_a_gap_cost_the_same_for_any_horizon(spark):
    daily = closes(spark)
    bench = daily.groupBy("d").agg(F.avg("c").alias("c"))
    horizons, gap = [2, 5, 20], 25
    df = E.population_returns(daily, bench, horizons, gap_days=gap, window=5, min_days=2)
    # No window frame slides over the bars of a horizon.
    assert "lead(_breaks" in executed(df) and "max(_gap" not in executed(df)
    got = {(r.ticker, r.d): r for r in df.collect()}
    days = {t: sorted(d for x, d in got if x == t) for t in "ABC"}
    for t, ds in days.items():
        for i, d in enumerate(ds):
            for h in horizons:
                ahead = ds[i : i + h + 2]
                whole = len(ahead) == h + 2 and all((b - a).days <= gap for a, b in zip(ahead, ahead[1:]))
                assert whole or got[t, d][f"adj_ret_{h}d"] is None, (t, d, h)
    assert any(r.adj_ret_20d is not None for r in got.values()) and any(r.adj_ret_2d is not None for r in got.values() if r.ticker == "B")


def test_events_are_scored_in_one_pass_over_the_bars(spark):
    daily = closes(spark)
    bench = daily.groupBy("d").agg((F.avg("c") + F.dayofmonth("d")).alias("c"))
    points = [(t, None if n is None else day(n)) for t in [*"ABCZ", None] for n in [*range(-2, 110, 3), None]]
    events = spark.createDataFrame(points, "ticker string, filing_date date")
    df = I.score_events(events, daily, bench, horizons=[2, 5], gap_days=25)
    bars = {t: sorted(r.d for r in daily.filter(F.col("ticker") == t).collect()) for t in "ABC"}
    betas = {(r.ticker, r.d): (r.beta, r.beta_n) for r in E.event_beta(E.returns_with_bench(daily, bench)).collect()}
    rows = df.collect()
    want = [(t, d, h) for t, d in points if t in bars and d is not None and bars[t][-1] > d for h in (2, 5)]
    assert sorted((r.ticker, r.filing_date, r.h) for r in rows) == sorted(want)
    for r in rows:
        before = [d for d in bars[r.ticker] if d < r.filing_date]
        assert (r.beta, r.beta_n) == (betas[r.ticker, before[-1]] if before else (None, None))
    assert any(r.beta for r in rows)
    # The bars meet the points once, not once for the entry and once for the beta.
    assert plan(df).count("Union") == 1


def test_owners_are_read_once(spark):
    filings = spark.createDataFrame([(i, day(20 * i), "4", "1" if i == 2 else "0", 7) for i in range(1, 5)], "accession int, filing_date date, document_type string, aff10b5one string, issuer int")
    lines = spark.createDataFrame([(i, "P", 10.0, 3.0) for i in range(1, 5)], "accession int, trans_code string, shares double, price double")
    rows = [(1, 5, "CFO", "Officer"), (1, 5, "CFO", "Officer"), (2, 5, None, "Director"), (3, 6, "Other", None)]
    owners = spark.createDataFrame(rows, "accession int, owner int, title string, relationship string")
    targets = spark.createDataFrame([(7,)], "issuer int")
    df = I.purchase_events(filings, lines, owners, targets)
    assert df.columns == ["accession", "filing_date", "issuer", "aff10b5one", "dollar_amt", "n_p_lines", "is_10b5_1", "size_bucket", "is_cluster", "role"]
    got = {r.accession: (r.is_cluster, r.role) for r in df.collect()}
    # Filing 4 names no owner: no role, and its day has no flag although two owners file around it.
    assert got == {1: (False, "CEO_CFO"), 2: (True, "Director"), 3: (True, "Other"), 4: (False, None)}
    # What is left to do starts from the settled filings, which hold their owners.
    assert plan(df).count("LogicalRDD") == 2
    lazy = I.purchase_events(filings, lines, owners, targets, settle_owners=False)
    assert lazy.columns == df.columns and {r.accession: (r.is_cluster, r.role) for r in lazy.collect()} == got
    # Where nobody reads role and flags, the owners are not read.
    assert "relationship" not in plan(lazy.select("accession", "is_10b5_1"))


def test_quantile_counts_move_once(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 7).alias("x"))
    q = exact_quantiles(df, ["g"], "x", {"a": 0.0, "m": 0.5, "p": 0.9, "z": 1.0})
    got = {r.g: r for r in q.collect()}
    vals = {g: np.array([(i * 7919) % 1009 / 7 for i in range(4000) if i % 3 == g]) for g in range(3)}
    for g, v in vals.items():
        assert np.allclose([got[g].a, got[g].m, got[g].p, got[g].z], np.quantile(v, [0, 0.5, 0.9, 1]), rtol=0, atol=1e-12)
    # The rows are counted once: splits, block sizes and scan read the same exchange.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(re.findall(r"\bRange \(0, 4000", executed(exact_quantiles(df, ["g"], "x", {"m": 0.5})))) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
