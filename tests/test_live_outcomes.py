import datetime as dt

import numpy as np
from conftest import ts
from pyspark.sql import functions as F

from tidemark.streaming import live as K
from tidemark.streaming.state import BARS

SIGNALS = K.OutcomeRun.SIGNALS


def market(seed=3):
    """Two tickers of minute bars over two days with gaps, and signals all over them."""
    rng = np.random.default_rng(seed)
    bars, signals, p = [], [], {"X": 50.0, "Y": 80.0}
    for d in (1, 4):
        for i in range(300):
            t = dt.datetime(2024, 3, d, 14, 30, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=i)
            for k in p:
                if rng.random() < 0.9:
                    o, p[k] = p[k], p[k] * (1 + 0.004 * rng.standard_normal())
                    bars.append((k, t, o, max(o, p[k]) * 1.001, min(o, p[k]) * 0.999, p[k], 5))
    for i in range(60):
        k, t = "XY"[i % 2], dt.datetime(2024, 3, 1 if i < 35 else 4, 14, 0, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=int(rng.integers(0, 420)), seconds=int(rng.integers(0, 60)))
        price = 50.0 if k == "X" else 80.0
        signals.append((i, k, t, price, price * 0.985 if i % 3 else None))
    return bars, signals


def land(spark, rows, schema, folder, parts, time):
    """Files of consecutive rows in time; `parts` is the order in which they land."""
    rows = sorted(rows, key=lambda r: r[time])
    cut = np.array_split(np.arange(len(rows)), max(parts) + 1)
    for name, k in enumerate(parts):
        spark.createDataFrame([rows[i] for i in cut[k]], schema).coalesce(1).write.parquet(f"{folder}/{name:02d}")
    return folder


def key(rows):
    return sorted((r.signal_id, r.exit_ts, round(r.exit_price, 9), r.stopped, round(r.ret_gross, 9), round(r.ret_net, 9)) for r in rows)


def test_outcomes_of_bars_in_time_are_written_once_and_of_late_ones_corrected(spark, tmp_path):
    bars, signals = market()
    newest = max(r[1] for r in bars)
    none = spark.createDataFrame([], "signal_id long")
    want = key(K.resolve_outcomes(spark.createDataFrame(signals, SIGNALS), none, spark.createDataFrame(bars, BARS), F.lit(newest)).collect())
    assert 20 < len(want) < 60 and any(r[3] for r in want)
    n = len(bars)
    thirds = [(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]
    # Signals first, then bars forward in time: no outcome twice.
    run, sent, cut = K.OutcomeRun(spark, str(tmp_path / "a")), spark.createDataFrame(signals, SIGNALS), sorted(bars, key=lambda r: r[1])
    for batch_id, (i, j) in enumerate(thirds):
        rows = run.arrivals(sent if batch_id == 0 else sent.limit(0), spark.createDataFrame(cut[i:j], BARS))
        run.step(rows, batch_id)
        if batch_id == 1:  # a replay of the newest batch repeats itself
            run.step(rows, batch_id)
    got = run.outcomes().collect()
    assert key(got) == want and {r.revision for r in got} == {1}
    # Bars of the middle come last: what they change is written again, and the end is the same.
    run = K.OutcomeRun(spark, str(tmp_path / "b"))
    for batch_id, (i, j) in enumerate((thirds[0], thirds[2], thirds[1])):
        run.step(run.arrivals(sent if batch_id == 0 else sent.limit(0), spark.createDataFrame(cut[i:j], BARS)), batch_id)
    got = run.outcomes().collect()
    assert key(got) == want and max(r.revision for r in got) == 2 and min(r.revision for r in got) == 1


def test_outcomes_on_a_stream_of_files_with_a_period_trigger(spark, tmp_path):
    import time

    bars, signals = market()
    land(spark, bars, BARS, str(tmp_path / "bars"), [0, 1, 2], 1)
    land(spark, signals, SIGNALS, str(tmp_path / "signals"), [1, 0], 2)
    run = K.OutcomeRun(spark, str(tmp_path / "o"), disorder_min=10)
    query = run.run(K.item_stream(spark, str(tmp_path / "signals" / "*"), SIGNALS, "parquet", "*.parquet", 1), K.item_stream(spark, str(tmp_path / "bars" / "*"), BARS, "parquet", "*.parquet", 1), every="1 seconds")
    end = time.time() + 120
    while time.time() < end and len([p for p in query.recentProgress if p.numInputRows]) < 3:
        time.sleep(1)
    query.processAllAvailable()
    query.stop()
    assert not query.isActive
    now = max(r[1] for r in bars) - dt.timedelta(minutes=10)
    want = K.resolve_outcomes(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame([], "signal_id long"), spark.createDataFrame(bars, BARS), F.lit(now)).collect()
    assert key(run.outcomes().collect()) == key(want)


def test_cycle_coverage(spark):
    sessions = spark.createDataFrame([(ts("2024-03-01T14:29:00"), ts("2024-03-01T14:45:00")), (ts("2024-03-04T14:30:00"), ts("2024-03-04T14:34:00"))], "sess_start timestamp, sess_end timestamp")
    cycles = K.expected_cycles(sessions)
    assert sorted(r.cycle_start.timestamp() for r in cycles.collect()) == sorted([ts("2024-03-01T14:30:00").timestamp() + 120 * i for i in range(7)] + [ts("2024-03-04T14:30:00").timestamp() + 120 * i for i in range(2)])
    rows = [("A", ts(f"2024-03-01T14:{m:02d}:30"), e) for m, e in ((30, None), (31, "x"), (36, "x"), (42, None), (46, None))] + [("A", ts("2024-03-04T14:30:00"), None), ("C", ts("2024-03-01T14:30:00"), None)]
    counts = K.poll_log(spark.createDataFrame(rows, "ticker string, t timestamp, error string"), "t")
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    got = {r.ticker: r for r in K.cycle_coverage(counts, cycles, tickers).collect()}
    assert (got["A"].n_expected, got["A"].n_polled, got["A"].n_failed_cycles, got["A"].n_failures, got["A"].n_missing) == (9, 4, 1, 2, 5)
    assert got["B"].missing_share == 1.0 and set(got) == {"A", "B"}
    gaps = sorted((r.ticker, r.first_missing.timestamp(), r.last_missing.timestamp(), r.n) for r in K.missing_cycles(counts, cycles, tickers).collect())
    at = lambda t: ts(t).timestamp()
    assert gaps == [("A", at("2024-03-01T14:32:00"), at("2024-03-01T14:34:00"), 2), ("A", at("2024-03-01T14:38:00"), at("2024-03-01T14:40:00"), 2), ("A", at("2024-03-04T14:32:00"), at("2024-03-04T14:32:00"), 1), ("B", at("2024-03-01T14:30:00"), at("2024-03-04T14:32:00"), 9)]
