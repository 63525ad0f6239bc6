"""Registered queries: outcomes and returns."""

from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators import outcomes as O
from tidemark.plans.alignment_queries import RB, regular
from tidemark.plans.registry import query

US = F.unix_micros


def r(c, n=8, name=None):
    return F.round(c, n).alias(name or c)


XB = "SELECT *, lead(idx,120) OVER w AS exit_idx, lead(ts,120) OVER w AS exit_ts, lead(close,120) OVER w AS exit_price FROM rb_v WINDOW w AS (PARTITION BY ticker ORDER BY ts)"
TRD = (
    "SELECT s.signal_id, s.ticker, CASE WHEN s.signal_id % 3 = 0 THEN 'short' ELSE 'long' END AS direction, b.ts AS entry_ts, b.idx AS entry_idx, b.open AS entry_price, b.exit_idx, b.exit_ts, b.exit_price, "
    "CASE WHEN s.signal_id % 5 = 0 THEN NULL WHEN s.signal_id % 7 = 0 THEN -1 ELSE b.open * (0.2 + (s.signal_id % 10)) END AS stop_dist FROM signals_v s ASOF JOIN xb_v b ON b.ticker=s.ticker AND b.ts >= s.ts_utc WHERE b.exit_idx IS NOT NULL"
)
G1 = (
    "SELECT t.*, h.idx IS NOT NULL AS stopped, CASE WHEN h.idx IS NULL THEN t.exit_price WHEN direction='long' THEN least(h.open, stop) ELSE greatest(h.open, stop) END AS exit_fill FROM (SELECT *, CASE WHEN stop_dist > 0 THEN CASE WHEN direction='long' THEN entry_price - stop_dist ELSE entry_price + stop_dist END END AS stop FROM trd_v) t "
    "LEFT JOIN (SELECT t.signal_id, min(b.idx) AS hidx FROM trd_v t JOIN rb_v b ON b.ticker=t.ticker AND b.idx BETWEEN t.entry_idx AND t.exit_idx WHERE t.stop_dist > 0 AND CASE WHEN t.direction='long' THEN b.low <= t.entry_price - t.stop_dist ELSE b.high >= t.entry_price + t.stop_dist END GROUP BY 1) m "
    "ON m.signal_id=t.signal_id LEFT JOIN rb_v h ON h.ticker=t.ticker AND h.idx=m.hidx"
)
V = {"rb_v": RB, "xb_v": XB, "trd_v": TRD, "g1_v": G1}


def trades(v):
    bars = regular(v)
    x = A.with_exit(bars).withColumn("exit_idx", F.when(F.col("exit_ts").isNotNull(), F.col("idx") + 120))
    i = F.col("signal_id")
    e = A.entry_bar(v.signals().select("signal_id", "ticker", "ts_utc"), x, "ts_utc", ["ts", "idx", "open", "exit_idx", "exit_ts", "exit_price"]).filter("bar.exit_idx IS NOT NULL")
    dist = F.when(i % 5 != 0, F.when(i % 7 == 0, -1.0).otherwise(F.col("bar.open") * (F.lit(0.2) + i % 10)))
    return e.select(
        "signal_id", "ticker", F.when(i % 3 == 0, "short").otherwise("long").alias("direction"), F.col("bar.ts").alias("entry_ts"), F.col("bar.idx").alias("entry_idx"), F.col("bar.open").alias("entry_price"),
        "bar.exit_idx", "bar.exit_ts", "bar.exit_price", dist.alias("stop_dist"),
    ), x


def stopped(v):
    t, bars = trades(v)
    return O.first_touch_exit(t, bars)


@query("g1_first_touch_stop", "SELECT signal_id, stopped, round(exit_fill,6) AS exit_fill FROM g1_v", **V)
def g1(v):
    return stopped(v).select("signal_id", "stopped", r("exit_fill", 6))


WC = "SELECT s.signal_id, s.ticker, s.stop_price, a.idx AS entry_idx, z.idx AS exit_idx FROM (SELECT signal_id, ticker, ts_utc, CASE WHEN class_name IN ('Buy','Strong Buy') THEN entry_price * 0.4 END AS stop_price FROM signals_v) s ASOF JOIN rb_v a ON a.ticker=s.ticker AND a.ts >= s.ts_utc ASOF JOIN rb_v z ON z.ticker=s.ticker AND z.ts >= s.ts_utc + INTERVAL '120' MINUTE"


@query(
    "g2_short_circuit_exit",
    "SELECT w.signal_id, coalesce(d.low <= w.stop_price AND w.stop_price <= d.high, false) AS stopped, CASE WHEN d.low <= w.stop_price AND w.stop_price <= d.high THEN w.stop_price ELSE z.close END AS exit_price, "
    "epoch_us(CASE WHEN d.low <= w.stop_price AND w.stop_price <= d.high THEN d.ts ELSE z.ts END) AS exit_us FROM wc_v w JOIN rb_v z ON z.ticker=w.ticker AND z.idx=w.exit_idx "
    "LEFT JOIN (SELECT w.signal_id, min(b.idx) AS i FROM wc_v w JOIN rb_v b ON b.ticker=w.ticker AND b.idx BETWEEN w.entry_idx AND w.exit_idx WHERE NOT coalesce(b.high < w.stop_price, false) GROUP BY 1) m ON m.signal_id=w.signal_id LEFT JOIN rb_v d ON d.ticker=w.ticker AND d.idx=m.i",
    rb_v=RB, wc_v=WC,
)
def g2(v):
    bars = A.with_exit(regular(v)).select("ticker", "idx", "ts", "open", "high", "low", "close")
    s = v.signals().select("signal_id", "ticker", "ts_utc", F.when(F.col("class_name").isin("Buy", "Strong Buy"), F.col("entry_price") * 0.4).alias("stop_price"))
    x = O.short_circuit_exit(O.wall_clock_window(s, bars, "ts_utc"), bars)
    return x.select("signal_id", "stopped", "exit_price", US("exit_ts").alias("exit_us"))


NET = "CASE WHEN direction='long' THEN exit_fill*(1-0.0003)/(entry_price*(1+0.0003)) - 1 ELSE 1 - exit_fill*(1+0.0003)/(entry_price*(1-0.0003)) END"
GROSS = "CASE WHEN direction='long' THEN exit_fill/entry_price - 1 ELSE 1 - exit_fill/entry_price END"


@query("g3_trade_returns", f"SELECT signal_id, round({GROSS},7) AS gross_ret, round({NET},7) AS net_ret FROM g1_v", **V)
def g3(v):
    return O.trade_returns(stopped(v)).select("signal_id", r("gross_ret", 7), r("net_ret", 7))


@query(
    "g4_benchmark_excess",
    f"SELECT g.signal_id, round(z.close/a.open - 1,7) AS bench_gross, round({GROSS} - CASE WHEN direction='long' THEN 1 ELSE -1 END*(z.close/a.open - 1),7) AS excess_gross FROM g1_v g ASOF LEFT JOIN (SELECT ts, open FROM rb_v WHERE ticker='view') a ON a.ts >= g.entry_ts ASOF LEFT JOIN (SELECT ts, close FROM rb_v WHERE ticker='view') z ON z.ts >= g.exit_ts",
    **V,
)
def g4(v):
    bench = regular(v).filter("ticker = 'view'").select("ts", "open", "close")
    return O.benchmark_excess(O.trade_returns(stopped(v)), bench, "entry_ts", "exit_ts").select("signal_id", r("bench_gross", 7), r("excess_gross", 7))


@query("g5_stop_level", "SELECT signal_id, round(CASE WHEN class_name IN ('Buy','Strong Buy') THEN entry_price*(1 - n_symbols*0.01) END,8) AS stop_price FROM signals_v")
def g5(v):
    return O.stop_level(v.signals().withColumn("atr", F.col("n_symbols") * 0.01), "atr").select("signal_id", r("stop_price"))


DD = (
    "SELECT ticker, max(pk - c) AS max_drawdown FROM (SELECT ticker, entry_ts, trade_id, c, max(c) OVER (PARTITION BY ticker ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, sum(net_ret) OVER (PARTITION BY ticker ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING) AS c FROM trades_v)) GROUP BY 1"
)


@query(
    "g6_trade_summary",
    "SELECT t.ticker, count(*) AS n, round(avg((net_ret>0)::INT),9) AS win, round(avg(net_ret),9) AS mean, round(quantile_cont(net_ret,0.5),9) AS median, round(sum(net_ret),6) AS sum, round(avg(net_ret)/(stddev_samp(net_ret)/sqrt(count(*))),6) AS t, round(any_value(d.max_drawdown),7) AS max_drawdown, "
    "round(avg(stopped::INT),9) AS stop_share, count(*) FILTER (direction='long') AS n_long, round(avg(net_ret) FILTER (direction='long'),9) AS mean_long, count(*) FILTER (direction='short') AS n_short, round(avg(net_ret) FILTER (direction='short'),9) AS mean_short, count(*) FILTER (severe) AS n_severe, "
    "round(avg(net_ret) FILTER (severe),9) AS mean_severe, round(avg(net_ret) FILTER (NOT severe),9) AS mean_nonsevere, round(avg(excess),9) AS excess_mean, round(avg(excess)/(stddev_samp(excess)/sqrt(count(excess))),6) AS excess_t FROM trades_v t JOIN dd_v d ON d.ticker=t.ticker GROUP BY 1",
    dd_v=DD,
)
def g6(v):
    s = O.trade_summary(v.trades(), ["ticker"], "entry_ts", "trade_id")
    return s.select(
        "ticker", "n", r("win", 9), r("mean", 9), r("median", 9), r("sum", 6), r("t", 6), r("max_drawdown", 7), r("stop_share", 9), "n_long", r("mean_long", 9), "n_short", r("mean_short", 9), "n_severe",
        r("mean_severe", 9), r("mean_nonsevere", 9), r("excess_mean", 9), r("excess_t", 6),
    )


HX = "('0x'||substr(md5({x}),1,8))::UBIGINT::BIGINT"


@query(
    "g7_random_trades",
    "SELECT signal_id, CASE WHEN " + HX.format(x="concat_ws('|','42-side',CAST(signal_id AS VARCHAR))") + " % 2 = 0 THEN 'long' ELSE 'short' END AS direction FROM (SELECT signal_id, row_number() OVER (ORDER BY "
    + HX.format(x="concat_ws('|','42',CAST(signal_id AS VARCHAR))") + ", signal_id) AS p FROM signals_v) WHERE p <= (SELECT count(*) FROM signals_v WHERE status='fired')",
)
def g7(v):
    n = v.signals().filter("status = 'fired'").agg(F.count(F.lit(1))).scalar()
    return O.random_trades(v.signals().select("signal_id"), "signal_id", n, "42").select("signal_id", "direction")


@query("g8_sentiment_trades", "SELECT id, CASE WHEN p0-p1 > 0.1 THEN 'long' ELSE 'short' END AS direction FROM probs_v WHERE p0-p1 > 0.1 OR p0-p1 < -0.1")
def g8(v):
    return O.sentiment_trades(v.probs().withColumn("s", F.col("p0") - F.col("p1")), "s", 0.1).select("id", "direction")


@query("g9_distinct_entries", "SELECT ticker, epoch_us(entry_ts) AS entry_us, min(signal_id) AS signal_id FROM trd_v GROUP BY 1,2", rb_v=RB, xb_v=XB, trd_v=TRD)
def g9(v):
    t, _ = trades(v)
    return O.distinct_entries(t, "entry_ts", "signal_id").select("ticker", US("entry_ts").alias("entry_us"), "signal_id")


@query(
    "g10_next_session_outcomes",
    "SELECT s.signal_id, a.sess_start IS NOT NULL AND a.sess_start IS DISTINCT FROM z.sess_start AS rolled FROM signals_v s LEFT JOIN sessions_v a ON s.ts_utc >= a.sess_start AND s.ts_utc < a.sess_end LEFT JOIN sessions_v z ON s.ts_utc + INTERVAL '120' MINUTE >= z.sess_start AND s.ts_utc + INTERVAL '120' MINUTE < z.sess_end",
)
def g10(v):
    s = v.signals().select("signal_id", "ts_utc", A.after("ts_utc", 120).alias("x"))
    return O.next_session_outcomes(s, "ts_utc", "x", v.sessions()).select("signal_id", "rolled")


@query(
    "g11_alert_reconciliation",
    "SELECT alert, count(*) AS n, round(avg((y=alert)::INT),9) AS precision, round(avg((ret>0)::INT),9) AS win, round(avg(ret),8) AS mean_ret, count(*) FILTER (y=0) AS n_true_0, round(avg(ret) FILTER (y=0),8) AS mean_true_0, count(*) FILTER (y=1) AS n_true_1, round(avg(ret) FILTER (y=1),8) AS mean_true_1, "
    "count(*) FILTER (y=2) AS n_true_2, round(avg(ret) FILTER (y=2),8) AS mean_true_2, count(*) FILTER (y=3) AS n_true_3, round(avg(ret) FILTER (y=3),8) AS mean_true_3 FROM (SELECT CASE WHEN p3 >= 0.45 THEN 3 ELSE 2 END AS alert, y, value/100 - 0.3 AS ret FROM probs_v WHERE p3 >= 0.45 OR p2 >= 0.42) GROUP BY 1",
)
def g11(v):
    f = v.probs().filter("p3 >= 0.45 OR p2 >= 0.42").withColumn("alert", F.when(F.col("p3") >= 0.45, 3).otherwise(2)).withColumn("ret", F.col("value") / 100 - 0.3)
    g = O.alert_reconciliation(f, "alert", "y", "ret")
    return g.select("alert", "n", r("precision", 9), r("win", 9), r("mean_ret"), *[c for k in range(4) for c in (f"n_true_{k}", r(f"mean_true_{k}"))])


# Three strategies over the same signals: fired long classes, a random side for every signal, and a rule.
BT_DEC = (
    "SELECT signal_id, ticker, ts_utc, n_symbols = 2 AS severe, 'champion' AS strategy, 'long' AS direction FROM signals_v WHERE status='fired' AND class_name IN ('Buy','Strong Buy') UNION ALL "
    "SELECT signal_id, ticker, ts_utc, n_symbols = 2, 'random', CASE WHEN " + HX.format(x="concat_ws('|','7-side',CAST(signal_id AS VARCHAR))") + " % 2 = 0 THEN 'long' ELSE 'short' END FROM signals_v UNION ALL "
    "SELECT signal_id, ticker, ts_utc, n_symbols = 2, 'rule', CASE WHEN n_symbols > 2 THEN 'long' ELSE 'short' END FROM signals_v WHERE n_symbols > 1"
)
BT_TRD = (
    "SELECT s.*, b.ts AS entry_ts, b.idx AS entry_idx, b.open AS entry_price, b.exit_idx, b.exit_ts, b.exit_price, b.open * 0.3 AS stop_dist FROM bd_v s ASOF JOIN xb_v b ON b.ticker=s.ticker AND b.ts >= s.ts_utc WHERE b.exit_idx IS NOT NULL"
)
BT_G = (
    "SELECT t.*, h.idx IS NOT NULL AS stopped, CASE WHEN h.idx IS NULL THEN t.exit_price WHEN direction='long' THEN least(h.open, entry_price - stop_dist) ELSE greatest(h.open, entry_price + stop_dist) END AS exit_fill FROM bt_v t "
    "LEFT JOIN (SELECT t.strategy, t.signal_id, min(b.idx) AS hidx FROM bt_v t JOIN rb_v b ON b.ticker=t.ticker AND b.idx BETWEEN t.entry_idx AND t.exit_idx WHERE CASE WHEN t.direction='long' THEN b.low <= t.entry_price - t.stop_dist ELSE b.high >= t.entry_price + t.stop_dist END GROUP BY 1,2) m "
    "ON m.signal_id=t.signal_id AND m.strategy=t.strategy LEFT JOIN rb_v h ON h.ticker=t.ticker AND h.idx=m.hidx"
)
BT_N = (
    f"SELECT g.strategy, g.signal_id, g.entry_ts, g.direction, g.stopped, {NET} AS net_ret, {GROSS} - CASE WHEN direction='long' THEN 1 ELSE -1 END*(z.close/a.open - 1) AS excess FROM bg_v g "
    "ASOF LEFT JOIN (SELECT ts, open FROM rb_v WHERE ticker='view') a ON a.ts >= g.entry_ts ASOF LEFT JOIN (SELECT ts, close FROM rb_v WHERE ticker='view') z ON z.ts >= g.exit_ts"
)
BT_DD = (
    "SELECT strategy, max(pk - c) AS dd FROM (SELECT *, max(c) OVER (PARTITION BY strategy ORDER BY entry_ts, signal_id ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, sum(net_ret) OVER (PARTITION BY strategy ORDER BY entry_ts, signal_id ROWS UNBOUNDED PRECEDING) AS c FROM bn_v)) GROUP BY 1"
)


@query(
    "g_backtest",
    "SELECT n.strategy, count(*) AS n, round(avg((net_ret>0)::INT),9) AS win, round(avg(net_ret),7) AS mean, round(quantile_cont(net_ret,0.5),7) AS median, round(avg(stopped::INT),9) AS stop_share, count(*) FILTER (direction='long') AS n_long, round(avg(excess),7) AS excess_mean, round(any_value(d.dd),5) AS max_drawdown FROM bn_v n JOIN bdd_v d ON d.strategy=n.strategy GROUP BY 1",
    rb_v=RB, xb_v=XB, bd_v=BT_DEC, bt_v=BT_TRD, bg_v=BT_G, bn_v=BT_N, bdd_v=BT_DD,
)
def g_backtest(v):
    """Decisions of three strategies to one summary: entries, exits, returns, excess."""
    from tidemark.functions.hashing import hash32

    s = v.signals().select("signal_id", "ticker", "ts_utc", (F.col("n_symbols") == 2).alias("severe"), "status", "class_name", "n_symbols")
    side = F.when(hash32(F.lit("7-side"), F.col("signal_id").cast("string")) % 2 == 0, "long").otherwise("short")
    fired = (F.col("status") == "fired") & F.col("class_name").isin("Buy", "Strong Buy")
    rule = F.when(F.col("n_symbols") > 2, "long").otherwise("short")
    parts = [s.filter(fired).withColumns({"strategy": F.lit("champion"), "direction": F.lit("long")}), s.withColumns({"strategy": F.lit("random"), "direction": side}), s.filter("n_symbols > 1").withColumns({"strategy": F.lit("rule"), "direction": rule})]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("status", "class_name", "n_symbols").withColumn("stop_share", F.lit(0.3))
    bars = v.keep(regular(v))
    t = v.keep(O.backtest(d, bars, bars.filter("ticker = 'view'").select("ts", "open", "close"), "ts_utc"))
    m = O.trade_summary(t, ["strategy"], "entry_ts", "signal_id")
    return m.select("strategy", "n", r("win", 9), r("mean", 7), r("median", 7), r("stop_share", 9), "n_long", r("excess_mean", 7), r("max_drawdown", 5))
