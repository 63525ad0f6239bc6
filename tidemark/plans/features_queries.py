"""Registered queries: point-in-time features."""

from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.scan import asof
from tidemark.operators import align as A
from tidemark.operators import features as E
from tidemark.plans.alignment_queries import RB, STUDY_EV, regular, study_events
from tidemark.plans.registry import query

US = F.unix_micros


def r(c, n=8, name=None):
    return F.round(c, n).alias(name or c)


HOURLY = (
    "SELECT ticker, date_trunc('hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
    "sum(volume)::BIGINT AS volume FROM bars_v GROUP BY 1,2"
)
HN = "SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc, close - lag(close) OVER w AS diff FROM hour_v WINDOW w AS (PARTITION BY ticker ORDER BY ts)"
RSI_R = (
    "SELECT ticker, ts, n, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d FROM hn_v WHERE n=1 UNION ALL SELECT h.ticker, h.ts, h.n, greatest(h.diff,0)/14 + p.u*13/14, greatest(-h.diff,0)/14 + p.d*13/14 "
    "FROM rsi_r p JOIN hn_v h ON h.ticker=p.ticker AND h.n=p.n+1"
)
MACD_R = (
    "SELECT ticker, ts, n, close, close AS f, close AS s FROM hn_v WHERE n=1 UNION ALL SELECT h.ticker, h.ts, h.n, h.close, h.close*2/13 + p.f*11/13, h.close*2/27 + p.s*25/27 "
    "FROM macd_r p JOIN hn_v h ON h.ticker=p.ticker AND h.n=p.n+1"
)
SIG_R = (
    "SELECT ticker, ts, n, close, f - s AS m, f - s AS g FROM macd_r WHERE n=26 UNION ALL SELECT h.ticker, h.ts, h.n, h.close, h.f - h.s, (h.f-h.s)*0.2 + p.g*0.8 "
    "FROM sig_r p JOIN macd_r h ON h.ticker=p.ticker AND h.n=p.n+1"
)
IND = (
    "SELECT h.ticker, h.ts, h.n, h.close, CASE WHEN h.n >= 14 THEN CASE WHEN r.d = 0 THEN 100 ELSE 100 - 100/(1 + r.u/nullif(r.d,0)) END END AS rsi, CASE WHEN h.n >= 34 THEN (g.m-g.g)/h.close END AS macd_hist, "
    "b.bb_pctb, b.bb_width, CASE WHEN h.n >= 14 THEN t.a/h.close END AS atr_pct FROM hn_v h JOIN rsi_r r USING (ticker, n) LEFT JOIN sig_r g USING (ticker, n) JOIN bb_v b USING (ticker, n) JOIN atr_v t USING (ticker, n)"
)
BB = (
    "SELECT ticker, n, CASE WHEN n >= 20 AND sd > 0 THEN (close - (mid - 2*sd))/(4*sd) END AS bb_pctb, CASE WHEN n >= 20 AND sd > 0 THEN 4*sd/close END AS bb_width FROM (SELECT *, avg(close) OVER w AS mid, stddev_pop(close) OVER w AS sd "
    "FROM hn_v WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
)
ATR = "SELECT ticker, n, avg(tr) OVER (PARTITION BY ticker ORDER BY n ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS a FROM (SELECT ticker, n, greatest(high-low, coalesce(abs(high-pc),0), coalesce(abs(low-pc),0)) AS tr FROM hn_v)"
H = {"hour_v": HOURLY, "hn_v": HN, "rsi_r": RSI_R, "macd_r": MACD_R, "sig_r": SIG_R, "bb_v": BB, "atr_v": ATR, "ind_v": IND, "rb_v": RB}


def hourly(v):
    return E.hourly_bars(v.bars())


@query("e1_hourly_resample", "SELECT ticker, epoch_us(ts) AS ts_us, open, high, low, close, volume FROM hour_v", **H)
def e1(v):
    return hourly(v).select("ticker", US("ts").alias("ts_us"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))


@query("e2_rsi", "SELECT ticker, epoch_us(ts) AS ts_us, round(rsi,6) AS rsi FROM ind_v", **H)
def e2(v):
    return E.rsi(hourly(v)).select("ticker", US("ts").alias("ts_us"), r("rsi", 6))


@query("e3_macd_histogram", "SELECT ticker, epoch_us(ts) AS ts_us, round(macd_hist,7) AS macd_hist FROM ind_v", **H)
def e3(v):
    return E.macd_hist(hourly(v)).select("ticker", US("ts").alias("ts_us"), r("macd_hist", 7))


@query("e4_bollinger", "SELECT ticker, epoch_us(ts) AS ts_us, round(bb_pctb,7) AS bb_pctb, round(bb_width,6) AS bb_width FROM ind_v", **H)
def e4(v):
    return E.bollinger(hourly(v)).select("ticker", US("ts").alias("ts_us"), r("bb_pctb", 7), r("bb_width", 6))


@query("e5_atr", "SELECT ticker, epoch_us(ts) AS ts_us, round(atr_pct,6) AS atr_pct FROM ind_v", **H)
def e5(v):
    return E.atr(hourly(v)).select("ticker", US("ts").alias("ts_us"), r("atr_pct", 6))


HE = "SELECT *, ts + INTERVAL '1' HOUR AS hour_end FROM ind_v WHERE n >= 30"


@query("d7_last_completed_hour", "SELECT s.signal_id, epoch_us(h.ts) AS hour_us, h.close FROM signals_v s ASOF LEFT JOIN he_v h ON h.ticker=s.ticker AND h.hour_end < s.ts_utc", he_v="SELECT *, ts + INTERVAL '1' HOUR AS hour_end FROM hn_v WHERE n >= 30", hour_v=HOURLY, hn_v=HN)
def d7(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc")
    j = E.last_completed_hour(s, hourly(v), "ts_utc", ["ts", "close"])
    return j.select("signal_id", US("hb.ts").alias("hour_us"), F.col("hb.close").alias("close"))


VW = "SELECT ticker, sess_start, ts, close, sum((high+low+close)/3.0*volume) OVER w AS pv, sum(volume) OVER w AS vol FROM sess_bars_v WINDOW w AS (PARTITION BY ticker, sess_start ORDER BY ts)"
VWS = (
    "SELECT e.signal_id, round(b.pv/b.vol, 7) AS vwap, round(b.close/(b.pv/b.vol) - 1, 8) AS dist_from_vwap FROM (SELECT s.signal_id, s.ticker, s.ts_utc, x.sess_start FROM signals_v s LEFT JOIN sessions_v x ON s.ts_utc >= x.sess_start AND s.ts_utc < x.sess_end) e "
    "ASOF LEFT JOIN vw_v b ON b.ticker=e.ticker AND b.sess_start=e.sess_start AND b.ts < e.ts_utc"
)


@query("d8_session_vwap", VWS, vw_v=VW)
def d8(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc")
    return E.session_vwap(s, v.bars(), v.sessions(), "ts_utc").select("signal_id", r("vwap", 7), r("dist_from_vwap"))


@query(
    "e6_technical_features",
    f"SELECT s.signal_id, round(h.rsi,6) AS rsi, round(h.macd_hist,7) AS macd_hist, round(h.atr_pct,6) AS atr_pct, d.dist_from_vwap FROM (SELECT * FROM signals_v s ASOF JOIN he_v h ON h.ticker=s.ticker AND h.hour_end < s.ts_utc) s "
    "JOIN he_v h ON h.ticker = s.ticker AND h.hour_end = s.hour_end JOIN vws_v d ON d.signal_id = s.signal_id",
    **H, he_v=HE, vw_v=VW, vws_v=VWS,
)
def e6(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc")
    f = E.technical_features(s, v.bars(), v.sessions(), "ts_utc").filter("hb IS NOT NULL")
    return f.select("signal_id", r("hb.rsi", 6, "rsi"), r("hb.macd_hist", 7, "macd_hist"), r("hb.atr_pct", 6, "atr_pct"), r("dist_from_vwap"))


@query(
    "e6_warmup_skips",
    "SELECT s.ticker, count(*) - count(h.ts) AS n_skipped FROM signals_v s ASOF LEFT JOIN he_v h ON h.ticker=s.ticker AND h.hour_end < s.ts_utc GROUP BY 1",
    he_v="SELECT *, ts + INTERVAL '1' HOUR AS hour_end FROM hn_v WHERE n >= 30", hour_v=HOURLY, hn_v=HN,
)
def e6s(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc")
    j = E.last_completed_hour(s, hourly(v), "ts_utc", ["close"])
    return j.groupBy("ticker").agg(F.count_if(F.col("hb").isNull()).alias("n_skipped"))


@query("e7_daily_close", "SELECT ticker, CAST(ts AS DATE) AS d, arg_max(close, ts) AS c FROM bars_v GROUP BY 1,2")
def e7(v):
    return E.daily_closes(v.bars())


BR = (
    "SELECT d, c/CASE WHEN n>=50 THEN f END - 1 AS dist_sma_fast, c/CASE WHEN n>=200 THEN s END - 1 AS dist_sma_slow, CASE WHEN n>=200 THEN (c > s)::INT END AS above_slow FROM (SELECT d, c, row_number() OVER (ORDER BY d) AS n, "
    "avg(c) OVER (ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS f, avg(c) OVER (ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS s FROM bench_v) WHERE n >= 30"
)


@query(
    "e8_benchmark_regime",
    "SELECT e.accession, round(b.dist_sma_fast,7) AS dist_sma_fast, round(b.dist_sma_slow,7) AS dist_sma_slow, b.above_slow FROM study_ev_v e ASOF LEFT JOIN br_v b ON b.d < e.filing_date",
    br_v=BR, study_ev_v=STUDY_EV,
)
def e8(v):
    j = E.prior_day(study_events(v), E.benchmark_regime(v.bench()), "filing_date", ["dist_sma_fast", "dist_sma_slow", "above_slow"], by=())
    return j.select("accession", r("pd.dist_sma_fast", 7, "dist_sma_fast"), r("pd.dist_sma_slow", 7, "dist_sma_slow"), F.col("pd.above_slow").alias("above_slow"))


@query("d10_prior_day", "SELECT e.accession, b.d, round(b.c,7) AS c FROM study_ev_v e ASOF LEFT JOIN daily_v b ON b.ticker=e.ticker AND b.d < e.filing_date", study_ev_v=STUDY_EV)
def d10(v):
    j = E.prior_day(study_events(v), v.daily(), "filing_date", ["d", "c"])
    return j.select("accession", F.col("pd.d").alias("d"), r("pd.c", 7, "c"))


TR = (
    "SELECT ticker, d, CASE WHEN n>=62 AND rs>=0 AND rl>0 THEN rs END AS rv_short, CASE WHEN n>=62 AND rs>=0 AND rl>0 THEN rs/rl END AS vol_ratio, CASE WHEN n>=62 AND rs>=0 AND rl>0 THEN m END AS mom FROM (SELECT ticker, d, n, "
    "stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rs, stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS rl, m FROM (SELECT ticker, d, "
    "row_number() OVER w AS n, ln(c/lag(c) OVER w) AS lr, c/lag(c,5) OVER w - 1 AS m FROM daily_v WINDOW w AS (PARTITION BY ticker ORDER BY d)))"
)
EVM = "SELECT e.accession, e.ticker, e.filing_date, CASE WHEN CAST(substr(e.ticker,2) AS INT) % 4 < 2 THEN 'A' ELSE 'B' END AS sector, b.rv_short, b.vol_ratio, b.mom FROM study_ev_v e ASOF LEFT JOIN tr_v b ON b.ticker=e.ticker AND b.d < e.filing_date"
M = {"tr_v": TR, "study_ev_v": STUDY_EV, "evm_v": EVM}


def study_universe(v):
    n = F.substring("ticker", 2, 20).cast("int")
    return v.tickers().withColumn("sector", F.when(n % 4 < 2, "A").otherwise("B"))


def events_with_regime(v):
    d = v.daily()
    j = E.prior_valid_day(study_events(v), d, E.ticker_regime(d), "filing_date", ["rv_short", "vol_ratio", "mom"])
    return j.select("accession", "ticker", "filing_date", "pd.rv_short", "pd.vol_ratio", "pd.mom")


@query("e9_ticker_regime", "SELECT accession, round(rv_short,7) AS rv_short, round(vol_ratio,7) AS vol_ratio, round(mom,7) AS mom FROM evm_v", **M)
def e9(v):
    return events_with_regime(v).select("accession", r("rv_short", 7), r("vol_ratio", 7), r("mom", 7))


@query(
    "e10_sector_momentum",
    "SELECT accession, round(CASE WHEN mom IS NOT NULL THEN avg(mom) OVER (PARTITION BY filing_date, sector) END,7) AS sector_mean_mom, round(mom - avg(mom) OVER (PARTITION BY filing_date, sector),7) AS sector_rel_mom FROM evm_v",
    **M,
)
def e10(v):
    s = E.sector_momentum(events_with_regime(v), study_universe(v), "mom", "filing_date")
    return s.select("accession", r("sector_mean_mom", 7), r("sector_rel_mom", 7))


@query(
    "e11_one_hot",
    "SELECT event_id, (event_type='click')::INT AS nt_click, (event_type='view')::INT AS nt_view, 0 AS nt_absent FROM events",
)
def e11(v):
    return E.one_hot(v.table("events").select("event_id", "event_type"), "event_type", ["click", "view", "absent"], "nt").drop("event_type")


@query(
    "e12_peer_momentum",
    "SELECT w.sector, w.filing_date AS date, round(avg(m.mom),7) AS peer_mom FROM (SELECT DISTINCT filing_date, sector FROM evm_v) w JOIN u_v u ON u.sector=w.sector ASOF LEFT JOIN mo_v m ON m.ticker=u.ticker AND m.d < w.filing_date GROUP BY 1,2",
    **M,
    u_v="SELECT DISTINCT ticker, CASE WHEN CAST(substr(ticker,2) AS INT) % 4 < 2 THEN 'A' ELSE 'B' END AS sector FROM daily_v",
    mo_v="SELECT * FROM (SELECT ticker, d, row_number() OVER w AS n, c/lag(c,5) OVER w - 1 AS mom FROM daily_v WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE n >= 6",
)
def e12(v):
    u = study_universe(v)
    dates = study_events(v).join(u, "ticker").select("sector", F.col("filing_date").alias("date"))
    return E.peer_momentum(u, v.daily(), dates).select("sector", "date", r("peer_mom", 7))


def _rec(lo):
    return (
        "SELECT signal_id, round((epoch_us(t) - epoch_us(max(t) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING)))/3.6e9, 6) AS hours_since_prev, "
        f"count(*) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN INTERVAL '{lo}' MICROSECOND PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING) AS items_prior FROM (SELECT signal_id, ticker, date_trunc('hour', ts_utc) AS t FROM signals_v)"
    )


def recency(v, inclusive):
    s = v.signals().select("signal_id", "ticker", F.date_trunc("hour", "ts_utc").alias("t"))
    return E.news_recency(s, s, "t", "t", inclusive_start=inclusive).select("signal_id", r("hours_since_prev", 6), "items_prior")


@query("e13_news_recency", _rec(86399999999))
def e13(v):
    return recency(v, False)


@query("e14_first_seen_recency", _rec(86400000000))
def e14(v):
    return recency(v, True)


@query(
    "e15_et_hour",
    "SELECT event_id, round(extract(hour FROM l) + extract(minute FROM l)/60.0::DOUBLE, 6) AS et_hour FROM (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM events)",
)
def e15(v):
    return v.table("events").select("event_id", F.round(E.et_hour("ts"), 6).alias("et_hour"))


ANCH = (
    "SELECT ticker, end_ts, ret FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS k FROM (SELECT ticker, row_number() OVER w - 1 AS i, lead(ts,120) OVER w AS end_ts, lead(close,120) OVER w/close - 1 AS ret FROM rb_v WINDOW w AS (PARTITION BY ticker ORDER BY ts)) "
    "WHERE i >= 60 AND (i-60) % 30 = 0 AND end_ts IS NOT NULL) WHERE k >= 5"
)
AV = {"rb_v": RB, "anch_v": ANCH}


@query("e16_sigma_anchors", "SELECT ticker, epoch_us(end_ts) AS end_us, round(ret,8) AS ret FROM anch_v", **AV)
def e16(v):
    return E.sigma_anchors(regular(v)).select("ticker", US("end_ts").alias("end_us"), r("ret"))


@query("e17_typical_sigma", "SELECT ticker, count(*) AS n_anchors, round(CASE WHEN count(*) >= 20 THEN stddev_samp(ret) END, 7) AS sigma FROM anch_v GROUP BY 1", **AV)
def e17(v):
    return E.typical_sigma(E.sigma_anchors(regular(v))).select("ticker", "n_anchors", r("sigma", 7))


SIG = (
    "SELECT s.signal_id, s.ticker, s.ts_utc, CASE WHEN a.k >= 10 THEN a.sd END AS sigma FROM signals_v s ASOF LEFT JOIN (SELECT ticker, end_ts, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS k FROM anch_v WINDOW w AS (PARTITION BY ticker ORDER BY end_ts)) a "
    "ON a.ticker=s.ticker AND a.end_ts < s.ts_utc"
)


@query("d9_trailing_sigma", "SELECT signal_id, round(sigma,7) AS sigma FROM sigma_v", **AV, sigma_v=SIG)
def d9(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc")
    return E.trailing_sigma(s, E.sigma_anchors(regular(v)), "ts_utc", 10).select("signal_id", r("sigma", 7))


@query("e18_expected_columns", "SELECT id, round(p0,9) AS p0, NULL::DOUBLE AS mom_5d, (y=1)::INT::DOUBLE AS nt_macro, 0.0::DOUBLE AS nt_absent FROM probs_v")
def e18(v):
    df = v.probs().withColumn("nt_macro", F.when(F.col("y") == 1, 1)).withColumn("p0", F.round("p0", 9))
    return E.align_columns(df, ["id", "p0", "mom_5d", "nt_macro", "nt_absent"]).withColumn("id", F.col("id").cast("long"))


@query("e19_dollar_volume", "SELECT ticker, round(avg(c*v),4) AS adv FROM daily_v WHERE d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1")
def e19(v):
    return E.average_dollar_volume(v.daily(), F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")).select("ticker", r("adv", 4))


RET = "SELECT p.ticker, p.d, p.c, b.bc, b.br, p.c/lag(p.c) OVER (PARTITION BY p.ticker ORDER BY p.d) - 1 AS r FROM daily_v p LEFT JOIN (SELECT d, c AS bc, c/lag(c) OVER (ORDER BY d) - 1 AS br FROM bench_v) b ON b.d=p.d"
RB20 = (
    "SELECT *, CASE WHEN k>=100 AND kv>=100 AND vr>0 THEN cv/vr END AS beta FROM (SELECT *, covar_samp(r,br) OVER w AS cv, count(r+br) OVER w AS k, var_samp(br) OVER w AS vr, count(br) OVER w AS kv FROM ret_v "
    "WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))"
)
EB21 = (
    "SELECT ticker, d, k AS beta_n, CASE WHEN n>=30 AND k>=30 AND vp>0 THEN cv/vp END AS beta FROM (SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) AS n, covar_samp(r,br) OVER w AS cv, count(r+br) OVER w AS k, var_pop(CASE WHEN r IS NOT NULL THEN br END) OVER w AS vp FROM ret_v "
    "WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 248 PRECEDING AND CURRENT ROW))"
)
B = {"ret_v": RET, "rbeta_v": RB20, "ebeta_v": EB21, "study_ev_v": STUDY_EV}


@query("e20_rolling_beta", "SELECT ticker, d, round(beta,6) AS beta FROM rbeta_v", **B)
def e20(v):
    return E.rolling_beta(E.returns_with_bench(v.daily(), v.bench())).select("ticker", "d", r("beta", 6))


@query("e21_event_beta", "SELECT e.accession, round(b.beta,6) AS beta, b.beta_n FROM study_ev_v e ASOF LEFT JOIN ebeta_v b ON b.ticker=e.ticker AND b.d < e.filing_date", **B)
def e21(v):
    betas = E.event_beta(E.returns_with_bench(v.daily(), v.bench()))
    j = asof(study_events(v), betas, ["ticker"], "filing_date", "d", ["beta", "beta_n"], exact=False, block=None)
    return j.select("accession", r("m.beta", 6, "beta"), F.col("m.beta_n").alias("beta_n"))


def _pop(h):
    return (
        f"CASE WHEN NOT coalesce(max(gap) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h + 1} FOLLOWING) > 25, false) THEN "
        f"lead(c,{h + 1}) OVER w/lead(c,1) OVER w - 1 - beta*(lead(bc,{h + 1}) OVER w/lead(bc,1) OVER w - 1) END AS adj_ret_{h}d"
    )


POP = (
    "SELECT ticker, d, " + ", ".join(_pop(h) for h in P.STUDY_HORIZONS)
    + " FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY ticker ORDER BY d), d) AS gap FROM rbeta_v) WINDOW w AS (PARTITION BY ticker ORDER BY d)"
)


@query("e22_population_returns", "SELECT ticker, d, round(adj_ret_5d,5) AS adj_ret_5d, round(adj_ret_20d,5) AS adj_ret_20d, round(adj_ret_60d,5) AS adj_ret_60d FROM pop_v", **B, pop_v=POP)
def e22(v):
    return E.population_returns(v.daily(), v.bench(), gap_days=25).select("ticker", "d", r("adj_ret_5d", 5), r("adj_ret_20d", 5), r("adj_ret_60d", 5))


@query(
    "e23_time_of_day",
    "SELECT s.signal_id, CASE WHEN epoch_us(s.ts_utc)-epoch_us(x.sess_start) < 3600000000 THEN 'first hour' WHEN epoch_us(x.sess_end)-epoch_us(s.ts_utc) <= 7200000000 THEN 'last 2h' ELSE 'midday' END AS tod FROM signals_v s JOIN sessions_v x ON s.ts_utc >= x.sess_start AND s.ts_utc < x.sess_end",
)
def e23(v):
    s = A.with_session(v.signals(), "ts_utc", v.sessions(), "inner")
    return s.select("signal_id", E.time_of_day("ts_utc", "sess_start", "sess_end").alias("tod"))


@query(
    "e24_leakage_checks",
    "SELECT count(*) AS n, count(*) FILTER (ts_utc < ts_utc) AS n_entry_before_news, count(*) FILTER (arrival <= ts_utc) AS n_exit_not_after_entry, count(*) FILTER (CAST(arrival AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) <> CAST(ts_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE)) AS n_overnight, "
    "round(quantile_cont((epoch_us(arrival)-epoch_us(ts_utc))/6e7, 0.5),6) AS median_delay_min, round(quantile_cont((epoch_us(arrival)-epoch_us(ts_utc))/6e7, 0.95),6) AS p95_delay_min FROM signals_v",
)
def e24(v):
    s = v.signals().withColumn("delay", A.seconds_between("ts_utc", "arrival"))
    chk = E.leakage_checks(s.withColumn("exit", F.col("arrival")).withColumn("entry", F.col("arrival")), "ts_utc", "entry", "exit", "delay")
    fixed = s.agg(F.count_if(F.col("arrival") <= F.col("ts_utc")))
    return chk.select(
        "n", "n_entry_before_news", fixed.scalar().alias("n_exit_not_after_entry"), "n_overnight", r("median_delay_min", 6), r("p95_delay_min", 6)
    )


@query(
    "e25_null_rates",
    "SELECT * FROM (SELECT 'rv_short' AS feature, round(avg((rv_short IS NULL)::INT),9) AS null_rate FROM evm_v UNION ALL SELECT 'vol_ratio', round(avg((vol_ratio IS NULL)::INT),9) FROM evm_v UNION ALL SELECT 'mom', round(avg((mom IS NULL)::INT),9) FROM evm_v)",
    **M,
)
def e25(v):
    return E.null_rates(events_with_regime(v), ["rv_short", "vol_ratio", "mom"]).select("feature", r("null_rate", 9))


