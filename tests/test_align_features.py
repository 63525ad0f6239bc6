import numpy as np
import pandas as pd
from conftest import ts
from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators import clean as C
from tidemark.operators import features as E
from tidemark.operators import filings as I


def sessions(spark):
    # Friday and Monday; the weekend and Tuesday (holiday) are closed.
    rows = [(ts("2024-03-01T14:30:00"), ts("2024-03-01T21:00:00")), (ts("2024-03-04T14:30:00"), ts("2024-03-04T21:00:00")), (ts("2024-03-06T14:30:00"), ts("2024-03-06T21:00:00"))]
    return spark.createDataFrame(rows, "sess_start timestamp, sess_end timestamp")


def minute_bars(spark, spans, ticker="X"):
    rows, p = [], 100.0
    for start, n in spans:
        for i in range(n):
            p += 0.5 if i % 3 else -0.7
            t = pd.Timestamp(start, tz="UTC") + pd.Timedelta(minutes=i)
            rows.append((ticker, t.to_pydatetime(), p, p + 0.3, p - 0.4, p + 0.1, 10 + i % 5))
    return spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume long")


def test_after_hours_roll_and_delay_gate(spark):
    bars = minute_bars(spark, [("2024-03-01 14:30", 390), ("2024-03-04 14:45", 100), ("2024-03-06 14:46", 100)])
    news = spark.createDataFrame(
        [
            (1, "X", ts("2024-03-01T15:00:00")),   # inside, on a bar
            (2, "X", ts("2024-03-01T15:00:00.000001")),  # inside, next bar
            (3, "X", ts("2024-03-01T21:30:00")),   # weekend ahead: Monday, delay exactly 15 min
            (4, "X", ts("2024-03-04T22:00:00")),   # holiday ahead: Wednesday, delay 16 min: out
            (5, "X", ts("2024-03-01T20:59:30")),   # inside, but the next bar is in another session: out
            (6, "X", ts("2024-03-07T00:00:00")),   # no bar after
        ],
        "id int, ticker string, published_utc timestamp",
    )
    got = {r.id: r for r in A.compute_events(news, bars, sessions(spark), horizon=5).collect()}
    assert set(got) == {1, 2, 3}
    utc = {i: pd.Timestamp(r.entry_ts.timestamp(), unit="s") for i, r in got.items()}
    assert utc[1] == pd.Timestamp("2024-03-01 15:00") and got[1].delay_sec == 0
    assert utc[2] == pd.Timestamp("2024-03-01 15:01") and got[2].delay_sec == 59
    assert utc[3] == pd.Timestamp("2024-03-04 14:45") and got[3].delay_sec == 900


def test_exit_counts_bars_and_crosses_sessions(spark):
    bars = A.with_exit(A.regular_bars(minute_bars(spark, [("2024-03-01 14:30", 390), ("2024-03-04 14:30", 20)]), sessions(spark)), 10)
    r = bars.filter("idx = 385").first()
    assert pd.Timestamp(r.exit_ts.timestamp(), unit="s") == pd.Timestamp("2024-03-04 14:34")


def test_near_and_exact_duplicates(spark):
    rows = [
        (1, "X", "Big News!", ts("2024-01-01T10:00:00")), (2, "X", "big news", ts("2024-01-01T10:09:00")), (3, "X", "BIG... news", ts("2024-01-01T10:18:00")),
        (4, "X", "Other", ts("2024-01-01T10:20:00")), (5, "X", "big news", ts("2024-02-01T10:20:00")), (6, "Y", "big news", ts("2024-01-01T10:01:00")), (7, "Y", "big news", ts("2024-01-01T10:11:00.000001")),
    ]
    news = spark.createDataFrame(rows, "id long, ticker string, headline string, t timestamp")
    assert sorted(r.id for r in C.near_duplicates(news, "t", "id").collect()) == [2, 3]
    assert sorted(r.id for r in C.dedupe_news(news, "t", "id").collect()) == [1, 4, 6]


def hourly(spark, closes):
    rows = [("X", pd.Timestamp("2024-01-01", tz="UTC").to_pydatetime() + pd.Timedelta(hours=i).to_pytimedelta(), c, c + 1, c - 1, c, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume long")


def by_time(df, col):
    return [r[col] for r in df.orderBy("ts").collect()]


def test_indicators_equal_pandas_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    c = pd.Series(100 + rng.normal(size=1500).cumsum())
    h = hourly(spark, [float(x) for x in c]).cache()
    d = c.diff()
    up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    dn = (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    want = 100 - 100 / (1 + up / dn)
    np.testing.assert_allclose(np.array(by_time(E.rsi(h), "rsi"), dtype=float), want, rtol=1e-9)
    macd = c.ewm(span=12, min_periods=12, adjust=False).mean() - c.ewm(span=26, min_periods=26, adjust=False).mean()
    want = (macd - macd.ewm(span=9, min_periods=9, adjust=False).mean()) / c
    np.testing.assert_allclose(np.array(by_time(E.macd_hist(h), "macd_hist"), dtype=float), want, rtol=1e-6, atol=1e-12)


def test_constant_price_and_warm_up(spark):
    b = E.bollinger(hourly(spark, [50.0] * 25))
    assert by_time(b, "bb_pctb") == [None] * 25 and by_time(b, "bb_width") == [None] * 25
    assert by_time(E.rsi(hourly(spark, [50.0] * 16)), "rsi") == [None] * 13 + [100.0] * 3
    assert by_time(E.atr(hourly(spark, [50.0] * 13)), "atr_pct") == [None] * 13


def test_hour_ending_at_the_event_is_not_visible(spark):
    h = hourly(spark, [float(i) for i in range(40)])
    ev = spark.createDataFrame([(1, "X", ts("2024-01-02T16:00:00")), (2, "X", ts("2024-01-02T16:00:00.000001")), (3, "X", ts("2024-01-02T05:00:00"))], "id int, ticker string, t timestamp")
    got = {r.id: (r.hb.close if r.hb else None) for r in E.last_completed_hour(ev, h, "t", ["close"]).collect()}
    assert got == {1: 38.0, 2: 39.0, 3: None}


def test_future_bars_change_no_feature(spark):
    past = minute_bars(spark, [("2024-03-01 14:30", 390), ("2024-03-04 14:30", 200)])
    more = past.unionByName(minute_bars(spark, [("2024-03-06 14:30", 300)]))
    ev = spark.createDataFrame([(i, "X", ts(f"2024-03-04T{15 + i % 3}:{10 + i}:30")) for i in range(12)], "id int, ticker string, t timestamp")

    def feats(bars):
        ind = E.hourly_indicators(E.hourly_bars(bars))
        f = E.last_completed_hour(ev, ind, "t", E.INDICATORS, min_bars=3)
        f = E.session_vwap(f, bars, sessions(spark), "t")
        return sorted(str(r) for r in E.trailing_sigma(f, E.sigma_anchors(bars, 10, 6, 3), "t", 5).select("id", "hb", "vwap", "dist_from_vwap", "sigma").collect())

    assert feats(past) == feats(more)


def test_recency_bounds_at_exactly_24_hours(spark):
    n = spark.createDataFrame([("X", ts("2024-01-01T12:00:00")), ("X", ts("2024-01-01T13:00:00")), ("X", ts("2024-01-02T12:00:00"))], "ticker string, nt timestamp")
    ev = spark.createDataFrame([(1, "X", ts("2024-01-02T12:00:00"))], "id int, ticker string, t timestamp")
    assert E.news_recency(ev, n, "t", "nt").first().items_prior == 1
    assert E.news_recency(ev, n, "t", "nt", inclusive_start=True).first().items_prior == 2
    assert E.news_recency(ev, n, "t", "nt").first().hours_since_prev == 23.0


def daily(spark, days):
    return spark.createDataFrame([("X", d, float(100 + i)) for i, d in enumerate(days)], "ticker string, d string, c double").withColumn("d", F.to_date("d"))


def test_halt_gap_right_after_entry_and_end_of_data(spark):
    path = A.daily_path(daily(spark, ["2024-01-01", "2024-01-02", "2024-02-01", "2024-02-02", "2024-02-03", "2024-02-04"]))
    ev = spark.createDataFrame([(1, "X", "2024-01-01"), (2, "X", "2024-01-31"), (3, "X", "2024-02-04")], "id int, ticker string, a string").withColumn("a", F.to_date("a"))
    got = {(r.id, r.h): r for r in A.study_exits(A.study_entries(ev, path, "a"), path, [2, 5]).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 2), (2, 5)}
    assert got[1, 2].ret == 0.0 and got[1, 2].truncated and str(got[1, 2].exit_date) == "2024-01-02"
    assert not got[2, 2].truncated and str(got[2, 2].exit_date) == "2024-02-03"
    assert got[2, 5].truncated and str(got[2, 5].exit_date) == "2024-02-04"


def test_cluster_window_is_30_days_and_counts_distinct_owners(spark):
    ev = spark.createDataFrame([(1, 10, "2024-01-01"), (2, 10, "2024-01-31"), (3, 20, "2024-01-01"), (4, 20, "2024-02-01"), (5, 30, "2024-01-01"), (6, 30, "2024-01-02")], "accession int, issuer int, d string")
    ev = ev.withColumn("filing_date", F.to_date("d"))
    own = spark.createDataFrame([(1, 7), (2, 8), (3, 7), (4, 8), (5, 7), (6, 7)], "accession int, owner int")
    got = {r.accession: r.is_cluster for r in I.cluster_flags(ev, own).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
