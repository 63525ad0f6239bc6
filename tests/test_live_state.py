import datetime as dt
import math
from pathlib import Path

import numpy as np
import pytest
from conftest import ts
from pyspark.sql import functions as F

from tidemark.operators import features as E
from tidemark.operators import frame as R
from tidemark.operators import labels as L
from tidemark.streaming import state as S

START = dt.date(2024, 1, 1)


def market(days=69, minutes=100, tickers=("X", "Y", "Z"), seed=1):
    """Minute bars of some days and tickers, with gaps; Z joins late."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, ticker in enumerate(tickers):
        p = 50.0 + 10 * k
        for d in range(days):
            if (d + k) % 16 == 5 or (ticker == "Z" and d < 40):
                continue
            open_ = dt.datetime.combine(START + dt.timedelta(days=d), dt.time(14, 30), dt.timezone.utc)
            for i in range(minutes):
                if rng.random() < 0.1:
                    continue
                p *= math.exp(0.002 * rng.standard_normal())
                q = p * math.exp(0.001 * rng.standard_normal())
                rows.append((ticker, open_ + dt.timedelta(minutes=i), p, max(p, q) * 1.0005, min(p, q) * 0.9995, q, int(rng.integers(0, 50))))
                p = q
    return rows


def day(i):
    return START + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("market"))
    rows = market()
    spark.createDataFrame(rows, S.BARS).write.parquet(f"{folder}/bars")
    bars = spark.read.parquet(f"{folder}/bars")

    def kept(data, schema, name):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    sessions = kept([(dt.datetime.combine(day(d), dt.time(14, 30), dt.timezone.utc), dt.datetime.combine(day(d), dt.time(21, 0), dt.timezone.utc)) for d in range(69)], "sess_start timestamp, sess_end timestamp", "sessions")
    bench = kept([(day(d - 200), 100.0 + d % 17 + d / 9) for d in range(268)], "d date, c double", "bench")
    universe = kept([("X", "A"), ("Y", "A"), ("Z", "B"), ("Q", "B")], "ticker string, sector string", "universe")
    return rows, bars, sessions, bench, universe


SEEN = [("X", ts("2024-03-06T20:00:00")), ("X", ts("2024-03-07T00:05:00")), ("Y", ts("2024-02-01T00:00:00"))]
EXPECTED = R.expected_columns(["A", "B"], ["earnings", "other"])


@pytest.fixture(scope="module")
def batch_frame(spark, made):
    _, bars, sessions, bench, universe = made
    seen = spark.createDataFrame(SEEN, "ticker string, nt timestamp")
    return R.feature_frame(items_of(spark, MOMENTS), bars, sessions, bench, universe, seen, EXPECTED, min_bars=20).collect()


def items_of(spark, moments):
    rows = [(f"h{i}", t, m, ["earnings", "other"][i % 2], 0.5, 0.25, 0.25, 0.25) for i, (t, m) in enumerate(moments)]
    return spark.createDataFrame(rows, "news_hash string, ticker string, published_utc timestamp, news_type string, p_pos double, p_neg double, p_neu double, sent_score double")


def at(d, hour, minute, ticker="X"):
    return ticker, dt.datetime.combine(day(d), dt.time(hour, minute), dt.timezone.utc)


MOMENTS = [at(66, 15, 31), at(66, 15, 0), at(66, 23, 59), at(67, 0, 10), at(67, 15, 45, "Y"), at(67, 16, 45), at(67, 14, 30, "Z"), at(67, 12, 0, "Q"), at(68, 15, 20, "Z"), at(68, 15, 59, "Y")]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9))


def test_live_frame_equals_batch_frame(spark, made, batch_frame, tmp_path):
    rows, bars, sessions, bench, universe = made
    expected, items, live_from = EXPECTED, items_of(spark, MOMENTS), day(66)
    seen = spark.createDataFrame(SEEN, "ticker string, nt timestamp")
    want = {r.news_hash: r for r in batch_frame}
    state = S.FeatureState(spark, str(tmp_path / "state"), sessions, bench, universe, expected, min_bars=20)
    got = {}
    state.add_bars(bars.filter(F.to_date("ts") < F.lit(live_from)), 0)
    state.roll(day(45))
    for n, d in enumerate((66, 67, 68)):
        # A day's bars come in two batches, the first of them twice.
        mine = bars.filter(F.to_date("ts") == F.lit(day(d)))
        for batch_id, part in ((2 * n + 1, "minute(ts) < 30"), (2 * n + 1, "minute(ts) < 30"), (2 * n + 2, "minute(ts) >= 30"))[n > 0 :]:
            state.add_bars(mine.filter(part), batch_id)
        part = items.filter(F.to_date("published_utc") == F.lit(day(d)))
        flow = E.news_recency(part.select("news_hash", "ticker", "published_utc"), seen, "published_utc", "nt", inclusive_start=True)
        frame = state.frame(part, day(d), flow)
        assert frame.columns == ["news_hash", "ticker", "published_utc", *expected]
        got.update({r.news_hash: r for r in frame.collect()})
    assert set(got) == set(want) and len(want) >= 8
    for h, r in want.items():
        assert {c: (r[c], got[h][c]) for c in expected if not close(r[c], got[h][c])} == {}
    full = want["h4"]
    assert [c for c in expected if full[c] is None] == [] and full.sect_A == 1.0 and full.nt_earnings == 1.0
    a, b = spark.createDataFrame(list(want.values())), spark.createDataFrame(list(got.values()), spark.createDataFrame(list(want.values())).schema)
    assert {r.flag for r in L.parity(a, b, "news_hash", expected, "ticker").collect()} == {"OK"}


def test_fold_in_any_cut_is_the_same_and_rebuild_takes_late_bars(spark, made, tmp_path):
    rows, bars, sessions, bench, universe = made
    some = bars.filter(F.to_date("ts") < F.lit(day(12)))
    results = []
    for name, cuts in (("one", [11]), ("many", [0, 4, 11])):
        state = S.FeatureState(spark, str(tmp_path / name), sessions, bench, universe, [])
        state.add_bars(some, 0)
        for c in cuts:
            state.roll(day(c))
        results.append({r.ticker: r.asDict(True) for r in state.carried(day(12))[1].collect()})
    assert set(results[0]) == set(results[1]) == {"X", "Y"}
    for t, a in results[0].items():
        b = results[1][t]
        for c in ("n", "n_days", "bars", "k", "last_end", "tail", "closes", "open"):
            assert a[c] == b[c], c
        assert all(close(a[c], b[c]) for c in ("eu", "ed", "f", "s", "g", "s1", "s2", "mom6"))
        assert all(close(a["last"][c], b["last"][c]) for c in E.INDICATORS)
    late = S.FeatureState(spark, str(tmp_path / "late"), sessions, bench, universe, [])
    missing = "ticker = 'X' AND hour(ts) = 15 AND to_date(ts) = '2024-01-03'"
    late.add_bars(some.filter(f"NOT ({missing})"), 0)
    late.roll(day(11))
    late.add_bars(some.filter(missing), 1)
    late.rebuild(day(2))
    fixed = {r.ticker: r.asDict(True) for r in late.carried(day(12))[1].collect()}
    assert all(fixed[t]["n"] == a["n"] and close(fixed[t]["eu"], a["eu"]) and fixed[t]["tail"] == a["tail"] for t, a in results[0].items())


def test_a_batch_reads_the_days_it_touches(spark, made, tmp_path):
    rows, bars, sessions, bench, universe = made
    state = S.FeatureState(spark, str(tmp_path / "s"), sessions, bench, universe, R.expected_columns(["A"], ["other"]), min_bars=5)
    state.add_bars(bars.filter((F.to_date("ts") < F.lit(day(60))) & (F.to_date("ts") > F.lit(day(54)))), 0)
    items = items_of(spark, [at(59, 16, 0)])
    flow = items.select("news_hash", F.lit(1.0).alias("hours_since_prev"), F.lit(0).alias("items_prior"))
    read = {f for f in state.frame(items, day(59), flow).inputFiles() if "/bars/" in f}
    assert read and all(f"day={day(59)}" in f or f"day={day(58)}" in f for f in read)

    seen = S.ItemState(spark, str(tmp_path / "i"))
    batch_of = lambda *rows: spark.createDataFrame([(h, "X", at(d, 10, 0)[1], at(a, 10, 1)[1]) for h, d, a in rows], "news_hash string, ticker string, published_utc timestamp, arrival timestamp")
    for d in range(9):
        seen.add(batch_of((f"n{d}", d, d)), d)
    assert [r.news_hash for r in seen.unseen(batch_of(("n9", 9, 9), ("n3", 3, 9), ("n8", 8, 9)), 9).collect()] == ["n9"]
    points, fresh = batch_of(("n9", 9, 9)).select("news_hash", "ticker", "published_utc"), spark.createDataFrame([("X", at(9, 10, 1)[1])], S.ItemState.ARRIVALS)
    for _ in range(2):  # the second time the snapshot of the first is read
        flow = seen.recency(points, fresh, 9, "published_utc")
        assert len([f for f in flow.inputFiles() if "/arrivals/" in f]) == 1
    r = flow.first()
    assert r.items_prior == 1 and math.isclose(r.hours_since_prev, 24 - 1 / 60)
    # An arrival of a day that a snapshot has closed still counts.
    seen.add(batch_of(("l", 1, 1)).withColumn("ticker", F.lit("L")), 9)
    r = seen.last_before(day(19), 10).filter("ticker = 'L'").first()
    assert r.nt.timestamp() == at(1, 10, 1)[1].timestamp()


def test_nothing_seen_yet(spark, made, tmp_path):
    _, _, sessions, bench, universe = made
    state = S.FeatureState(spark, str(tmp_path / "e"), sessions, bench, universe, R.expected_columns(["A"], ["other"]))
    state.roll(day(3))
    items = items_of(spark, [at(4, 10, 0)])
    flow = items.select("news_hash", F.lit(1.0).alias("hours_since_prev"), F.lit(0).alias("items_prior"))
    assert state.frame(items, day(4), flow).count() == 0 and not Path(state.root, "carry").exists()
    assert S.ItemState(spark, str(tmp_path / "f")).unseen(items, 0).count() == 1


def test_live_run_scores_the_whole_frame(spark, made, tmp_path):
    from tidemark.operators import text as X
    from tidemark.streaming import live as K

    rows, bars, sessions, bench, universe = made
    expected = R.expected_columns(["A", "B"], ["earnings", "other"])
    few = bars.filter(F.to_date("ts").between(F.lit(day(60)), F.lit(day(66)))).cache()
    state = S.FeatureState(spark, str(tmp_path / "s"), sessions, bench, universe, expected, min_bars=3)
    state.add_bars(few, 0)
    asked = []

    def score(df):
        asked.append(df.columns)
        p = F.when(F.col("rsi").isNotNull() | F.col("atr_pct").isNull(), 0.6).otherwise(0.5)
        return df.withColumns({"p0": F.lit(0.1), "p1": F.lit(0.1), "p2": F.lit(0.2), "p3": p, "severity": F.col("et_hour")})

    patterns = X.matchers(spark.createDataFrame([("X", "Xylo Works Inc"), ("Y", "Yonder Mills")], "ticker string, name string"))
    run = K.LiveRun(spark, str(tmp_path / "out"), few, sessions, patterns, score, {"Strong Buy": 0.4}, (-1.0, 1.0), min_bars=3, features=state)
    (_, a), (_, b) = at(66, 15, 40), at(66, 15, 50)
    items = spark.createDataFrame([("X", "Xylo Works beats", "", "s", a, b, "http://x", 2, "f"), ("Y", "nothing here", "", "s", a, b, None, None, "f")], "ticker string, headline string, summary string, source string, published_utc timestamp, arrival timestamp, url string, n_symbols int, news_source string")
    run.process(items, 0)
    run.process(items, 1)
    (r,) = spark.read.parquet(f"{run.root}/signals").collect()
    assert set(expected) <= set(asked[0]) and (r.headline, r.status, r.url, r.n_symbols, r.prob_raw, r.severe) == ("Xylo Works beats", "fired", "http://x", 2, 0.6, 1)
    assert math.isclose(r.severity, 10 + 40 / 60) and r.items_prior == 0 and r.signal_id is not None
