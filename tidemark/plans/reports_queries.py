"""Registered queries: report tables and quality gates."""

from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators import features as E
from tidemark.operators import reports as R
from tidemark.operators import stats as S
from tidemark.operators import text as X
from tidemark.plans.features_queries import AV, BR, SIG, EVM, STUDY_EV, TR, events_with_regime
from tidemark.plans.labels_queries import DEC, PRED, decisions, predicted
from tidemark.plans.statistics_queries import PCT, boot
from tidemark.plans.text_queries import PROSE_TYPES, TIER, _type_sql, profiled
from tidemark.plans.registry import query

US = F.unix_micros


def r(c, n=9, name=None):
    return F.round(c, n).alias(name or c)


@query(
    "j1_counts",
    "SELECT 'class_name' AS dimension, class_name AS value, count(*) AS n FROM signals_v GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM signals_v GROUP BY 2 UNION ALL SELECT 'news_source', news_source, count(*) FROM signals_v GROUP BY 2",
)
def j1(v):
    return R.counts_by_sets(v.signals(), ["class_name", "status", "news_source"])


PIVOT = "SELECT ticker, count(*) FILTER (class_name='Sell') AS \"Sell\", count(*) FILTER (class_name='Neutral') AS \"Neutral\", count(*) FILTER (class_name='Buy') AS \"Buy\", count(*) FILTER (class_name='Strong Buy') AS \"Strong Buy\", count(*) AS total FROM signals_v GROUP BY 1"


@query("j2_ticker_class_pivot", PIVOT)
def j2(v):
    return R.ticker_class_pivot(v.signals())


@query(
    "j3_exclusion_funnel",
    "SELECT * FROM (SELECT 0 AS step, 'all rows' AS name, count(*) AS n FROM signals_v UNION ALL SELECT 1, 'after window', count(*) FROM signals_v WHERE ts_utc >= TIMESTAMP '2024-01-05' UNION ALL SELECT 2, 'not corporate action', count(*) FROM signals_v WHERE ts_utc >= TIMESTAMP '2024-01-05' AND NOT (ticker='error' AND n_symbols=1) "
    "UNION ALL SELECT 3, 'has symbols', count(*) FROM signals_v WHERE ts_utc >= TIMESTAMP '2024-01-05' AND NOT (ticker='error' AND n_symbols=1) AND n_symbols > 0)",
)
def j3(v):
    ca = (F.col("ticker") == "error") & (F.col("n_symbols") == 1)
    return R.funnel(v.signals(), [("after window", F.col("ts_utc") >= F.lit("2024-01-05").cast("timestamp")), ("not corporate action", ~ca), ("has symbols", F.col("n_symbols") > 0)])


ETD = "CAST({c} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE)"


@query(
    "j4_sample_gates",
    f"SELECT nfd AS n_fired_days, nf AS n_fired, nd AS n_days, CASE WHEN nfd >= 40 AND nf >= 300 THEN 'minimum sample reached' ELSE 'too small to conclude' END AS verdict FROM (SELECT count(DISTINCT {ETD.format(c='ts_utc')}) FILTER (status='fired') AS nfd, count(*) FILTER (status='fired') AS nf, count(DISTINCT {ETD.format(c='ts_utc')}) AS nd FROM signals_v)",
)
def j4(v):
    return R.sample_gates(v.signals(), "ts_utc")


GRP = "SELECT unnest(list_filter(['all signals', class_name, CASE WHEN status='fired' AND class_name IN ('Buy','Strong Buy') THEN 'fired Buy/Strong Buy' END], lambda g: g IS NOT NULL)) AS grp, CAST(ts_utc AS DATE) AS day, ln(entry_price) - 3 AS x FROM signals_v"
GC = "SELECT grp, day, sum(x) AS c_sum, count(*) AS c_n, avg(x) AS c_mean, count(*) FILTER (x < 0) AS c_neg FROM grp_v GROUP BY 1,2"


@query(
    "j5_group_table",
    "SELECT c.grp, sum(c_n)::BIGINT AS n, count(*) AS n_days, round(avg(c_mean),8) AS day_mean, round(sum(c_sum)/sum(c_n),8) AS pooled, round(sum(c_neg)/sum(c_n),9) AS neg_share, sum(c_n) < 30 AS thin, any_value(b.lo) AS lo, any_value(b.hi) AS hi FROM gc_v c JOIN b_v b ON b.grp=c.grp GROUP BY 1",
    grp_v=GRP, gc_v=GC, b_v=boot("gc_v", "grp", "avg(c.c_mean)", 100, "42", "day", PCT),
)
def j5(v):
    g = R.with_report_groups(v.signals()).withColumn("x", F.ln("entry_price") - 3).withColumn("day", F.to_date("ts_utc"))
    s = S.summarize(g, ["grp"], "day", "x", 100, "42")
    return s.select("grp", "n", "n_days", r("day_mean", 8), r("pooled", 8), r("neg_share"), "thin", r("lo", 8), r("hi", 8))


GT = (
    "SELECT unnest(list_filter(['all signals', s.class_name, CASE WHEN s.status='fired' AND s.class_name IN ('Buy','Strong Buy') THEN 'fired Buy/Strong Buy' END], lambda g: g IS NOT NULL)) AS grp, t.day, t.net_ret, t.excess FROM trades_v t JOIN signals_v s ON s.signal_id=t.trade_id"
)
GM = "SELECT grp, 'raw' AS measure, day, net_ret AS x FROM gt_v UNION ALL SELECT grp, 'adjusted', day, excess FROM gt_v"
GMC = "SELECT grp, measure, day, sum(x) AS c_sum, count(x) AS c_n, avg(x) AS c_mean, count(*) FILTER (x < 0) AS c_neg FROM gm_v WHERE x IS NOT NULL GROUP BY 1,2,3"


@query(
    "j5_raw_and_adjusted",
    "SELECT c.grp, c.measure, sum(c_n)::BIGINT AS n, count(*) AS n_days, round(avg(c_mean),8) AS day_mean, round(sum(c_sum)/sum(c_n),8) AS pooled, round(sum(c_neg)/sum(c_n),9) AS neg_share, sum(c_n) < 30 AS thin, any_value(b.lo) AS lo, any_value(b.hi) AS hi FROM gmc_v c JOIN b_v b ON b.grp=c.grp AND b.measure=c.measure GROUP BY 1,2",
    gt_v=GT, gm_v=GM, gmc_v=GMC, b_v=boot("gmc_v", "grp,measure", "avg(c.c_mean)", 50, "42", "day", PCT),
)
def j5a(v):
    """Net return and excess over the benchmark for every report group."""
    s = v.signals().select(F.col("signal_id").alias("trade_id"), "class_name", "status")
    t = R.raw_and_adjusted(v.trades().join(s, "trade_id"), "net_ret", "excess")
    return S.summarize(t, ["grp", "measure"], "day", "x", 50, "42").select("grp", "measure", "n", "n_days", r("day_mean", 8), r("pooled", 8), r("neg_share"), "thin", r("lo", 8), r("hi", 8))


BK = (
    "SELECT accession, d.dimension, d.bucket FROM (SELECT accession, unnest([{'dimension':'benchmark','bucket':CASE WHEN above IS NULL THEN 'benchmark missing' WHEN above=1 THEN 'benchmark high' ELSE 'benchmark low' END}, {'dimension':'vol','bucket':CASE WHEN vol_ratio IS NULL THEN 'vol missing' WHEN vol_ratio > 1 THEN 'vol high' ELSE 'vol low' END}, "
    "{'dimension':'mom','bucket':CASE WHEN mom IS NULL THEN 'mom missing' WHEN mom > 0 THEN 'mom high' ELSE 'mom low' END}, {'dimension':'tod','bucket':coalesce(tod,'tod missing')}]) AS d FROM (SELECT *, CASE WHEN accession % 3 < 2 THEN accession % 3 END AS above, CASE WHEN accession % 5 > 0 THEN 'midday' END AS tod FROM evm_v))"
)


@query("j6_regime_breakdown", "SELECT dimension, bucket, count(*) AS n FROM bk_v GROUP BY 1,2", tr_v=TR, study_ev_v=STUDY_EV, evm_v=EVM, bk_v=BK)
def j6(v):
    a = F.col("accession")
    e = events_with_regime(v).withColumn("above", F.when(a % 3 < 2, a % 3)).withColumn("tod", F.when(a % 5 > 0, "midday"))
    return R.regime_buckets(e, "above", "vol_ratio", "mom", "tod").groupBy("dimension", "bucket").agg(F.count(F.lit(1)).alias("n"))


#: A month of bars holds no 60 days; the long volatility window is 20 days here.
SHORT_LONG = (5, 20)
TRB = (
    "SELECT ticker, d, CASE WHEN n>=22 AND rs>=0 AND rl>0 THEN rs/rl END AS vol_ratio, CASE WHEN n>=22 AND rs>=0 AND rl>0 THEN m END AS mom FROM (SELECT ticker, d, n, "
    "stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rs, stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rl, m FROM (SELECT ticker, d, "
    "row_number() OVER w AS n, ln(c/lag(c) OVER w) AS lr, c/lag(c,5) OVER w - 1 AS m FROM (SELECT ticker, CAST(ts AS DATE) AS d, arg_max(close, ts) AS c FROM bars_v GROUP BY 1,2) WINDOW w AS (PARTITION BY ticker ORDER BY d)))"
)
TB = (
    "SELECT t.trade_id, t.day, t.excess, b.above_slow AS above, a.vol_ratio, a.mom, CASE WHEN x.sess_start IS NULL THEN NULL WHEN epoch_us(t.entry_ts)-epoch_us(x.sess_start) < 3600000000 THEN 'first hour' WHEN epoch_us(x.sess_end)-epoch_us(t.entry_ts) <= 7200000000 THEN 'last 2h' ELSE 'midday' END AS tod "
    "FROM (SELECT * FROM trades_v WHERE excess IS NOT NULL) t ASOF LEFT JOIN trb_v a ON a.ticker=t.ticker AND a.d < t.day ASOF LEFT JOIN br9_v b ON b.d < t.day LEFT JOIN sessions_v x ON t.entry_ts >= x.sess_start AND t.entry_ts < x.sess_end"
)
TBK = (
    "SELECT d.dimension AS dimension, d.bucket AS bucket, day, excess FROM (SELECT day, excess, unnest([{'dimension':'benchmark','bucket':CASE WHEN above IS NULL THEN 'benchmark missing' WHEN above=1 THEN 'benchmark high' ELSE 'benchmark low' END}, {'dimension':'vol','bucket':CASE WHEN vol_ratio IS NULL THEN 'vol missing' WHEN vol_ratio > 1 THEN 'vol high' ELSE 'vol low' END}, "
    "{'dimension':'mom','bucket':CASE WHEN mom IS NULL THEN 'mom missing' WHEN mom > 0 THEN 'mom high' ELSE 'mom low' END}, {'dimension':'tod','bucket':coalesce(tod,'tod missing')}]) AS d FROM tb_v)"
)


@query(
    "j6_breakdown_summary",
    "SELECT c.dimension, c.bucket, sum(c_n)::BIGINT AS n, count(*) AS n_days, round(avg(c_mean),8) AS day_mean, round(sum(c_sum)/sum(c_n),8) AS pooled, round(sum(c_neg)/sum(c_n),9) AS neg_share, sum(c_n) < 30 AS thin, any_value(b.lo) AS lo, any_value(b.hi) AS hi FROM tbc_v c JOIN b_v b ON b.dimension=c.dimension AND b.bucket=c.bucket GROUP BY 1,2",
    br_v=BR, br9_v="SELECT d + 9131 AS d, above_slow FROM br_v", trb_v=TRB, tb_v=TB, tbk_v=TBK,
    tbc_v="SELECT dimension, bucket, day, sum(excess) AS c_sum, count(*) AS c_n, avg(excess) AS c_mean, count(*) FILTER (excess < 0) AS c_neg FROM tbk_v GROUP BY 1,2,3",
    b_v=boot("tbc_v", "dimension,bucket", "avg(c.c_mean)", 50, "42", "day", PCT),
)
def j6s(v):
    """Trades' excess by benchmark regime, volatility regime, momentum sign and time of day, with the summary of H3 for
    every bucket; the buckets come from the prior-day regimes and the session of the entry."""
    daily = E.daily_closes(v.bars())
    bench = v.bench().select(F.date_add("d", 9131).alias("d"), "c")
    t = v.trades().filter("excess IS NOT NULL").select("trade_id", "ticker", "entry_ts", "day", "excess")
    t = E.prior_valid_day(t, daily, E.ticker_regime(daily, *SHORT_LONG), "entry_ts", ["vol_ratio", "mom"])
    t = A.with_session(E.prior_day(t, E.benchmark_regime(bench), "entry_ts", ["above_slow"], by=(), out="_b"), "entry_ts", v.sessions())
    tod = F.when(F.col("sess_start").isNotNull(), E.time_of_day("entry_ts", "sess_start", "sess_end"))
    rows = R.regime_buckets(t.select("day", "excess", F.col("_b.above_slow").alias("above"), "pd.vol_ratio", "pd.mom", tod.alias("tod")), "above", "vol_ratio", "mom", "tod")
    return S.summarize(rows, ["dimension", "bucket"], "day", "excess", 50, "42").select("dimension", "bucket", "n", "n_days", r("day_mean", 8), r("pooled", 8), r("neg_share"), "thin", r("lo", 8), r("hi", 8))


@query("j7_negative_share", "SELECT count(*) AS n, round(avg((ln(entry_price) < 1)::INT),9) AS negative_share FROM signals_v WHERE class_name='Sell'")
def j7(v):
    return R.negative_share(v.signals().withColumn("x", F.ln("entry_price") - 1), "x").select("n", r("negative_share"))


@query("j8_failure_summary", "SELECT ticker, count(*) AS n, epoch_us(min(ts_utc)) AS first_us, epoch_us(max(ts_utc)) AS last_us FROM signals_v WHERE n_symbols = 0 GROUP BY 1")
def j8(v):
    f = R.failure_summary(v.signals().filter("n_symbols = 0"))
    return f.select("ticker", "n", US("first_seen").alias("first_us"), US("last_seen").alias("last_us"))


WIL = "round((p + 3.8416/(2*n))/(1+3.8416/n) {s} 1.96*sqrt(p*(1-p)/n + 3.8416/(4*n*n))/(1+3.8416/n),9)"


@query(
    "j9_outcome_summary",
    f"SELECT class_name, n::BIGINT AS n, round(p,9) AS win, {WIL.format(s='-')} AS win_lo, {WIL.format(s='+')} AS win_hi, round(mn,9) AS mean_net, round(sr,9) AS stop_rate FROM (SELECT class_name, count(*)::DOUBLE AS n, avg((net_ret>0)::INT) AS p, avg(net_ret) AS mn, avg(stopped::INT) AS sr FROM trades_v JOIN signals_v ON signal_id=trade_id GROUP BY 1)",
)
def j9(v):
    o = v.trades().select(F.col("trade_id").alias("signal_id"), F.col("net_ret").alias("ret_net"), "stopped")
    return R.outcome_summary(v.signals(), o).select("class_name", "n", r("win"), r("win_lo"), r("win_hi"), r("mean_net"), r("stop_rate"))


@query(
    "j10_valid_days",
    "SELECT c.day, c.n_cycles, round(c.e,9) AS error_rate, round(c.u,9) AS uptime, round(f.p,9) AS proxy_share, round(coalesce(w.k,0)/c.n_cycles,9) AS worst_missing_share, c.u >= 0.95 AND coalesce(f.p,0) <= 0.2 AND c.e < 0.05 AND coalesce(w.k,0)/c.n_cycles <= 0.1 AS valid FROM "
    "(SELECT day, count(*) AS n_cycles, avg((NOT ok)::INT) AS e, sum(up)/sum(2.0::DOUBLE) AS u FROM (SELECT CAST(ts AS DATE) AS day, event_id % 25 <> 0 AS ok, CASE WHEN event_id % 31 = 0 THEN 0.5 ELSE 2.0 END AS up FROM events) GROUP BY 1) c "
    "LEFT JOIN (SELECT CAST(ts_utc AS DATE) AS day, avg((n_symbols = 3)::INT) AS p FROM signals_v WHERE status='fired' GROUP BY 1) f ON f.day=c.day LEFT JOIN (SELECT day, max(k) AS k FROM (SELECT CAST(ts_utc AS DATE) AS day, ticker, count(*) AS k FROM signals_v WHERE n_symbols=0 AND signal_id % 8 = 0 GROUP BY 1,2) GROUP BY 1) w ON w.day=c.day",
)
def j10(v):
    i = F.col("event_id")
    cyc = v.table("events").select(F.to_date("ts").alias("day"), (i % 25 != 0).alias("ok"), F.when(i % 31 == 0, 0.5).otherwise(2.0).alias("up_min"), F.lit(2.0).alias("session_min"))
    s = v.signals().withColumn("day", F.to_date("ts_utc"))
    fired = s.filter("status = 'fired'").select("day", F.when(F.col("n_symbols") == 3, "proxy").otherwise("live_trade").alias("entry_source"))
    fails = s.filter("n_symbols = 0 AND signal_id % 8 = 0").select("day", "ticker")
    return R.valid_days(cyc, fired, fails).select("day", "n_cycles", r("error_rate"), r("uptime"), r("proxy_share"), r("worst_missing_share"), "valid")


CT = "SELECT 1 AS one, day, sum(excess) AS c_sum, count(*) AS c_n, avg(excess) AS c_mean FROM trades_v WHERE excess IS NOT NULL GROUP BY 2"


@query(
    "j11_decision_rule",
    "SELECT lo > 0 AS ci_above_zero, p < 0.05 AS p_small, t >= 2 AS t_large, drift <= 0.10 AS calibrated, stop BETWEEN 0.1 AND 0.6 AND proxy < 0.2 AS sane, CASE WHEN lo > 0 AND p < 0.05 AND t >= 2 AND drift <= 0.1 AND stop BETWEEN 0.1 AND 0.6 AND proxy < 0.2 THEN 'promote' ELSE 'keep watching' END AS verdict FROM "
    "(SELECT lo, p_le_0 AS p FROM b_v), (SELECT avg(c_mean)/(stddev_samp(c_mean)/sqrt(count(*))) AS t FROM ct_v), (SELECT avg(stopped::INT) AS stop FROM trades_v), "
    "(SELECT abs(avg(p3) - avg((y=3)::INT)) AS drift FROM (SELECT *, ntile(10) OVER (ORDER BY p3, id) AS bin FROM probs_v) WHERE bin = 10), (SELECT avg((n_symbols=3)::INT) AS proxy FROM signals_v WHERE status='fired')",
    ct_v=CT, b_v=boot("ct_v", "", "avg(c.c_mean)", 100, "42", "day", "quantile_cont(m,0.025) AS lo, avg((m<=0)::INT) AS p_le_0"),
)
def j11(v):
    """Drift is the gap of the top bin of the reliability table; the proxy share is that of fired signals."""
    from tidemark.operators import labels as L

    t = v.trades()
    st = S.cluster_stats(t, [], "day", "excess").select("t")
    one = S.cluster_bootstrap(t, [], "day", "excess", 100, "42").withColumn("t", st.scalar())
    stop = t.agg(F.avg(F.col("stopped").cast("double")).alias("s"))
    top = L.reliability(v.probs(), "p3", F.col("y") == 3, "id", 10).filter("bin = 10")
    proxy = v.signals().filter("status = 'fired'").agg(F.avg((F.col("n_symbols") == 3).cast("double")).alias("p"))
    return R.decision_rule(one, top.select(F.abs(F.col("mean_pred") - F.col("emp_freq"))).scalar(), stop.scalar(), proxy.scalar())


@query(
    "j12_day_blocks",
    f"SELECT class_name, block, n::BIGINT AS n, round(p,9) AS win, lo, hi, lo <= phi AND hi >= plo AS overlaps_pooled FROM (SELECT b.*, {WIL.format(s='-')} AS lo, {WIL.format(s='+')} AS hi FROM (SELECT class_name, block, count(*)::DOUBLE AS n, avg((x>0)::INT) AS p FROM dd_v GROUP BY 1,2) b) x JOIN (SELECT class_name AS c2, {WIL.format(s='-')} AS plo, {WIL.format(s='+')} AS phi FROM (SELECT class_name, count(*)::DOUBLE AS n, avg((x>0)::INT) AS p FROM dd_v GROUP BY 1)) q ON q.c2=x.class_name",
    dd_v="SELECT class_name, net_ret AS x, ((dense_rank() OVER (PARTITION BY class_name ORDER BY day) - 1)//20)::INT AS block FROM trades_v JOIN signals_v ON signal_id=trade_id",
)
def j12(v):
    d = v.trades().join(v.signals().select(F.col("signal_id").alias("trade_id"), "class_name"), "trade_id")
    return R.day_blocks(d, "day", "net_ret").select("class_name", "block", "n", r("win"), r("lo"), r("hi"), "overlaps_pooled")


LAG = "SELECT *, (epoch_us(arrival)-epoch_us(ts_utc))/6e7 + entry_price/1000 AS lag, CAST(ts_utc AS DATE) AS day FROM signals_v"
LQ = "count(*) AS n, round(min(lag),7) AS min, round(avg(lag),7) AS mean, round(max(lag),7) AS max, round(quantile_cont(lag,0.5),7) AS median, round(quantile_cont(lag,0.9),7) AS p90, round(quantile_cont(lag,0.95),7) AS p95"


def lagged(v):
    return v.signals().withColumn("lag", (US("arrival") - US("ts_utc")) / F.lit(6e7) + F.col("entry_price") / 1000).withColumn("day", F.to_date("ts_utc"))


def lag_cols(*by):
    return [*by, "n", *[r(c, 7) for c in ("min", "mean", "max", "median", "p90", "p95")]]


@query("j13_retrieval_lag", f"SELECT {LQ} FROM lag_v", lag_v=LAG)
def j13(v):
    return R.lag_summary(lagged(v), "lag").select(*lag_cols())


@query("j13_retrieval_lag_per_day", f"SELECT day, {LQ} FROM lag_v GROUP BY 1", lag_v=LAG)
def j13d(v):
    return R.lag_summary(lagged(v), "lag", ["day"]).select(*lag_cols("day"))


@query("j13_retrieval_lag_cdf", "SELECT c AS cut, round(avg((lag <= c)::INT),9) AS share FROM lag_v CROSS JOIN (VALUES (15),(30),(60),(120)) t(c) GROUP BY 1", lag_v=LAG)
def j13c(v):
    return R.lag_cdf(lagged(v), "lag").select("cut", r("share"))


@query(
    "j14_two_hop_latency",
    f"SELECT news_source, 'publish_to_seen' AS hop, {LQ} FROM lag_v GROUP BY 1 UNION ALL SELECT news_source, 'seen_to_decided' AS hop, {LQ} FROM lag2_v GROUP BY 1",
    lag_v=LAG, lag2_v="SELECT s.news_source, (s.signal_id % 13)/4.0::DOUBLE + s.entry_price/10000 AS lag FROM signals_v s",
)
def j14(v):
    s = lagged(v)
    first = R.lag_summary(s, "lag", ["news_source"]).withColumn("hop", F.lit("publish_to_seen"))
    key = F.md5(F.concat_ws("|", "news_source", "ticker", F.col("signal_id").cast("string")))
    log = s.select(key.alias("h"), ((F.col("signal_id") % 13) / F.lit(4.0) + F.col("entry_price") / 10000).alias("lag"))
    hop2 = s.select(key.alias("h"), "news_source").join(log, "h")
    second = R.lag_summary(hop2, "lag", ["news_source"]).withColumn("hop", F.lit("seen_to_decided"))
    return first.unionByName(second).select(*lag_cols("news_source", "hop"))


@query("j15_feed_coverage", "SELECT u.ticker, count(*) FILTER (news_source='feed1' AND x) AS feed1, count(*) FILTER (news_source='feed2' AND x) AS feed2, round(count(*) FILTER (news_source='feed2' AND x)/nullif(count(*) FILTER (news_source='feed1' AND x),0),9) AS ratio FROM universe_v u LEFT JOIN (SELECT *, ticker <> 'error' AS x FROM signals_v) s ON s.ticker=u.ticker GROUP BY 1")
def j15(v):
    return R.feed_coverage(v.universe(), v.signals().filter("ticker <> 'error'"), ["feed1", "feed2"]).select("ticker", "feed1", "feed2", r("ratio"))


@query(
    "j16_coverage_gap",
    "SELECT count(DISTINCT o_custkey) FILTER (m) AS n_missing_tickers, count(*) FILTER (m) AS n_signals_missing, round(avg(m::INT),9) AS share FROM (SELECT o_custkey, o_custkey NOT IN (SELECT doc_id FROM labels) AS m FROM orders)",
)
def j16(v):
    s = v.table("orders").select(F.col("o_custkey").alias("ticker"))
    return R.coverage_gap(s, v.table("labels").select(F.col("doc_id").alias("ticker"))).select("n_missing_tickers", "n_signals_missing", r("share"))


@query("j17_shared_value_share", "SELECT count(*) AS n, round(avg((k > 1)::INT),9) AS shared_share FROM (SELECT count(*) OVER (PARTITION BY value) AS k FROM events)")
def j17(v):
    return R.shared_value_share(v.table("events"), "value").select("n", r("shared_share"))


NEWC = "SELECT signal_id, class_name AS old, CASE WHEN entry_price*1.05 < 10 THEN 'Sell' WHEN entry_price*1.05 < 45 THEN 'Neutral' WHEN entry_price*1.05 < 100 THEN 'Buy' ELSE 'Strong Buy' END AS new FROM signals_v"


@query("j18_class_transitions", "SELECT old, new, count(*) AS n, count(*) FILTER (old <> new) AS n_flipped FROM nc_v GROUP BY 1,2", nc_v=NEWC)
def j18(v):
    s = v.signals()
    p = F.col("entry_price") * 1.05
    new = s.select("signal_id", F.when(p < 10, "Sell").when(p < 45, "Neutral").when(p < 100, "Buy").otherwise("Strong Buy").alias("class_name"))
    return R.transitions(s, new, "signal_id", "class_name")


@query(
    "j19_action_impact",
    "SELECT inside, count(*) AS n, round(quantile_cont(vol_ratio,0.5),7) AS median FROM (SELECT e.*, EXISTS (SELECT 1 FROM filings_v f WHERE f.document_type='4/A' AND concat('S', f.issuer)=e.ticker AND f.filing_date <= e.filing_date AND f.filing_date > e.filing_date - 30) AS inside FROM evm_v e) GROUP BY 1",
    tr_v=TR, study_ev_v=STUDY_EV, evm_v=EVM,
)
def j19(v):
    act = v.filings().filter("document_type = '4/A'").select(F.concat(F.lit("S"), "issuer").alias("ticker"), F.col("filing_date").alias("ex_date"))
    e = v.keep(events_with_regime(v))
    return R.action_impact(e, act, "filing_date", "vol_ratio", 30).select("inside", "n", r("median", 7))


@query("j20_extreme_moves", "SELECT ticker, d, round(m,7) AS move FROM (SELECT ticker, d, c/lag(c) OVER (PARTITION BY ticker ORDER BY d) - 1 AS m FROM daily_v) WHERE abs(m) > 0.5")
def j20(v):
    return R.extreme_moves(v.daily()).select("ticker", "d", r("move", 7))


@query(
    "j20_splits_in_windows",
    "SELECT accession, EXISTS (SELECT 1 FROM filings_v f WHERE f.document_type='4/A' AND f.issuer=e.issuer AND f.filing_date > e.filing_date AND f.filing_date <= e.filing_date + 30) AS spans_action FROM filings_v e",
)
def j20s(v):
    act = v.filings().filter("document_type = '4/A'").select(F.concat(F.lit("S"), "issuer").alias("ticker"), F.col("filing_date").alias("ex_date"))
    w = v.filings().select("accession", F.concat(F.lit("S"), "issuer").alias("ticker"), "filing_date", F.date_add("filing_date", 30).alias("exit_date"))
    return R.actions_in_windows(w, act, "filing_date", "exit_date").select("accession", "spans_action")


@query(
    "j21_dataset_counts",
    "SELECT 'tier' AS kind, tier::VARCHAR AS value, count(*) AS n FROM tier_v GROUP BY 2 UNION ALL SELECT 'type', news_type, count(*) FROM type_v GROUP BY 2 "
    "UNION ALL SELECT 'valid', 'with headline', count(*) FILTER (headline <> '') FROM news_v UNION ALL SELECT 'valid', 'with time', count(published_utc) FROM news_v",
    tier_v=TIER, type_v=_type_sql(PROSE_TYPES),
)
def j21c(v):
    news = v.news()
    typed = news.withColumn("news_type", X.news_type("headline", "summary", PROSE_TYPES))
    return R.dataset_counts(X.relevance_tier(news, X.matchers(profiled(v))), typed, {"with headline": F.col("headline") != "", "with time": F.col("published_utc").isNotNull()})


@query("j21_dataset_summary", "SELECT ticker, count(*) AS n, count(sigma) AS n_sigma, round(quantile_cont(sigma,0.5),7) AS median_sigma FROM sigma_v GROUP BY 1", **AV, sigma_v=SIG)
def j21(v):
    from tidemark.operators import features as E
    from tidemark.plans.alignment_queries import regular

    s = v.signals().select("signal_id", "ticker", "ts_utc")
    d = v.keep(E.trailing_sigma(s, E.sigma_anchors(regular(v)), "ts_utc", 10))
    return R.dataset_summary(d, "sigma").select("ticker", "n", "n_sigma", r("median_sigma", 7))


@query("j22_sample_rows", "SELECT class_name, signal_id FROM (SELECT class_name, signal_id, row_number() OVER (PARTITION BY class_name ORDER BY ('0x'||substr(md5(concat_ws('|','7',CAST(signal_id AS VARCHAR))),1,8))::UBIGINT, signal_id) AS k FROM signals_v) WHERE k <= 4")
def j22(v):
    return R.sample_rows(v.signals().select("class_name", "signal_id"), "class_name", "signal_id", 4, "7")


@query("j23_group_means", "SELECT source, count(*) AS n, round(avg(n_chars),6) AS mean_n_chars FROM documents GROUP BY 1")
def j23(v):
    return R.group_means(v.table("documents"), "source", ["n_chars"]).select("source", "n", r("mean_n_chars", 6))


@query(
    "j24_shadow_status",
    f"SELECT count(*) AS n, count(*) FILTER (status='fired') AS n_fired, count(DISTINCT {ETD.format(c='ts_utc')}) FILTER (status='fired') AS active_days, min({ETD.format(c='ts_utc')}) AS first_day, max({ETD.format(c='ts_utc')}) AS last_day, ((epoch_us(max(ts_utc))-epoch_us(min(ts_utc)))//86400000000)::INT AS span_days, round(avg((n_symbols=3)::INT) FILTER (status='fired'),9) AS proxy_share FROM signals_v",
)
def j24(v):
    s = v.signals().withColumn("entry_source", F.when(F.col("n_symbols") == 3, "proxy").otherwise("live_trade"))
    return R.shadow_status(s, "ts_utc", "entry_source").withColumn("proxy_share", F.round("proxy_share", 9))


@query("j25_summary_only", "SELECT count(*) AS n FROM tier_v WHERE tier = 2 AND news_id IN (SELECT signal_id FROM signals_v WHERE status = 'fired')", tier_v=TIER)
def j25(v):
    m = X.matchers(profiled(v))
    full = X.relevance_tier(v.news(), m)
    head = X.relevance_tier(v.news().withColumn("summary", F.lit(None).cast("string")), m)
    return R.summary_only_fired(full, head, "news_id", v.signals().filter("status = 'fired'").select(F.col("signal_id").alias("news_id")))


@query(
    "j26_calibration_shape",
    "SELECT y AS class_id, count(*) AS n_breakpoints, round(min(q),9) AS min_out, round(max(q),9) AS max_out, sum((q = pq)::INT)::BIGINT AS n_flat FROM (SELECT *, lag(q) OVER (PARTITION BY y ORDER BY g, q) AS pq FROM (SELECT y, g, floor(g/7)/10.0::DOUBLE AS q FROM (SELECT DISTINCT y, floor(p1*100)::INT AS g FROM probs_v))) GROUP BY 1",
)
def j26(v):
    g = v.probs().select(F.col("y").alias("class_id"), F.floor(F.col("p1") * 100).cast("int").alias("x")).distinct()
    s = R.calibration_shape(g.withColumn("y", F.floor(F.col("x") / 7) / F.lit(10.0)))
    return s.select("class_id", "n_breakpoints", r("min_out"), r("max_out"), "n_flat")


@query(
    "j27_cohort_comparison",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}) FILTER (y=3),7) AS mean_in, round(avg({f}) FILTER (y<>3),7) AS mean_out, round(quantile_cont({f},0.5) FILTER (y=3),7) AS median_in, round(quantile_cont({f},0.5) FILTER (y<>3),7) AS median_out, round(avg({f}) FILTER (y=3)/avg({f}) FILTER (y<>3),6) AS mean_ratio FROM probs_v"
        for f in ("p0", "p3", "value")
    ),
)
def j27(v):
    c = R.cohort_comparison(v.probs().withColumn("c", F.col("y") == 3), "c", ["p0", "p3", "value"])
    return c.select("feature", r("mean_in", 7), r("mean_out", 7), r("median_in", 7), r("median_out", 7), r("mean_ratio", 6))


@query("j27_accuracy_range", "SELECT round(min(a),9) AS min_acc, round(max(a),9) AS max_acc FROM (SELECT ticker, avg((y=pred)::INT) AS a FROM pred_v GROUP BY 1)", pred_v=PRED)
def j27a(v):
    return R.accuracy_range(predicted(v), "ticker", F.col("y") == F.col("pred")).select(r("min_acc"), r("max_acc"))


@query("j28_five_numbers", "SELECT count(value) AS n, round(avg(value),7) AS mean, round(stddev_samp(value),7) AS sd, min(value) AS min, round(quantile_cont(value,0.25),7) AS q25, round(quantile_cont(value,0.5),7) AS median, round(quantile_cont(value,0.75),7) AS q75, max(value) AS max FROM events")
def j28(v):
    return S.describe(v.table("events"), "value").select("n", r("mean", 7), r("sd", 7), "min", r("q25", 7), r("median", 7), r("q75", 7), "max")


@query(
    "j29_fire_rates",
    "SELECT id % 4 = 0 AS placebo, count(*) AS n, round(avg((status='fired' AND class_name='Buy')::INT),9) AS fire_buy, round(avg((status='fired' AND class_name='Strong Buy')::INT),9) AS fire_strong_buy, round(avg(prob_calibrated),8) AS mean_prob FROM dec_v GROUP BY 1",
    dec_v=DEC,
)
def j29(v):
    d = R.fire_rates(decisions(v).withColumn("placebo", F.col("id") % 4 == 0), ["placebo"], "prob_calibrated")
    return d.select("placebo", "n", r("fire_buy"), r("fire_strong_buy"), r("mean_prob", 8))


@query("j30_multi_symbol_share", "SELECT count(*) AS n, round(avg((n_symbols>=2)::INT),9) AS multi_share, count(*) FILTER (n_symbols <= 1) AS n_at_most_1 FROM signals_v WHERE status='fired'")
def j30(v):
    return R.multi_symbol_share(v.signals()).select("n", r("multi_share"), "n_at_most_1")


@query(
    "j31_service_coverage",
    "SELECT s.d, round(coalesce(sum(greatest(epoch_us(least(m.e, s.sess_end)) - epoch_us(greatest(m.s, s.sess_start)),0)),0)/6e7,6) AS down_min, round(1 - coalesce(sum(greatest(epoch_us(least(m.e, s.sess_end)) - epoch_us(greatest(m.s, s.sess_start)),0)),0)/6e7/960,8) AS uptime FROM sessions_v s LEFT JOIN mg_v m ON m.s < s.sess_end AND m.e > s.sess_start GROUP BY 1",
    dn_v="SELECT ts_utc AS s, arrival AS e FROM signals_v WHERE class_name='Strong Buy' AND arrival > ts_utc",
    mg_v="SELECT min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce((s > max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT,1) AS nw FROM dn_v)) GROUP BY g",
)
def j31(v):
    d = v.signals().filter("class_name = 'Strong Buy' AND arrival > ts_utc").select("ts_utc", "arrival")
    return R.service_coverage(d, v.sessions(), "ts_utc", "arrival").select("d", r("down_min", 6), r("uptime", 8))


