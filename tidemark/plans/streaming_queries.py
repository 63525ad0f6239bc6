"""Registered queries: streaming operators run over the tables as file streams."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators import frame as R
from tidemark.operators import labels as L
from tidemark.operators import text as X
from tidemark.plans.alignment_queries import RB, regular
from tidemark.plans.features_queries import ANCH, BR, H, HE, HN, HOURLY, VW, VWS
from tidemark.plans.labels_queries import pool
from tidemark.plans.registry import query
from tidemark.plans.text_queries import TIER, profiled
from tidemark.schemas import TEST_TABLES
from tidemark.session import checkpoint_dir
from tidemark.streaming import live as K
from tidemark.streaming.state import FeatureState

US = F.unix_micros


def root(v):
    return f"{checkpoint_dir(v.spark)}/stream-{uuid.uuid4().hex}"


def stream(v, name):
    return K.table_stream(v.spark, v.folder, name, TEST_TABLES[name])


def event_items(v):
    i = F.col("event_id")
    return stream(v, "events").select(
        i.alias("id"), F.col("event_type").alias("ticker"), F.col("ts").alias("published_utc"), F.timestamp_micros(US("ts") + (i % 90) * 60_000_000).alias("arrival"), F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("news_hash"), "value"
    )


@query("k2_once_only_items", "SELECT md5(concat_ws('|', event_type, user_id)) AS news_hash, 1 AS one FROM events GROUP BY 1")
def k2(v):
    return K.first_sightings(event_items(v).select("news_hash", "arrival"), root(v), "items", "arrival").select("news_hash", F.lit(1).alias("one"))


@query("k3_late_gate", "SELECT event_id AS id, (event_id % 90)::DOUBLE AS lag_minutes, (event_id % 90 > 60)::INT AS rejected_stale FROM events")
def k3(v):
    s = K.with_lag(event_items(v), "published_utc", "arrival").select("id", "lag_minutes", "rejected_stale")
    return K.run_available(s, root(v), "lag").drop("batch_id")


@query("k4_two_feeds", "SELECT 'feed1' AS news_source, event_id AS id FROM events WHERE value < 40 UNION ALL SELECT 'feed2', event_id FROM events WHERE value >= 40")
def k4(v):
    e = event_items(v).select("id", "value")
    s = K.union_feeds({"feed1": e.filter("value < 40"), "feed2": e.filter("value >= 40").withColumn("n_symbols", F.lit(1))})
    return K.run_available(s, root(v), "feeds").select("news_source", "id")


@query("k5_enriched_items", "SELECT news_id, tier AS relevance_tier FROM tier_v", tier_v=TIER)
def k5(v):
    docs = stream(v, "documents")
    ev = v.table("events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("ticker"))
    items = docs.join(ev, "doc_id").select(F.col("doc_id").alias("news_id"), "ticker", F.regexp_extract("text", r"^[^.\n]*", 0).alias("headline"), F.col("text").alias("summary"), "source")
    s = K.enrich(items, X.matchers(profiled(v)))
    return K.run_available(s, root(v), "enriched").select("news_id", "relevance_tier")


@query("k9_story_windows", "SELECT event_type AS ticker, epoch_us(time_bucket(INTERVAL '15' MINUTE, ts)) AS bucket_us, count(*) AS n FROM events GROUP BY 1,2")
def k9(v):
    got = K.counted(event_items(v), root(v), "stories", lambda df: K.story_counts(df, "published_utc"))
    return got.select("ticker", US("bucket").alias("bucket_us"), "n")


@query("k12_failure_counts", "SELECT event_type AS ticker, epoch_us(time_bucket(INTERVAL '2' MINUTE, ts)) AS cycle_us, count(*) AS n FROM events GROUP BY 1,2")
def k12(v):
    got = K.counted(event_items(v), root(v), "failures", lambda df: K.failure_counts(df, "published_utc"))
    return got.select("ticker", US("cycle_start").alias("cycle_us"), "n")


@query("k13_session_gate", "SELECT e.event_id AS id FROM events e JOIN sessions_v s ON e.ts >= s.sess_start AND e.ts < s.sess_end")
def k13(v):
    return K.run_available(K.in_session(event_items(v), "published_utc", v.sessions()).select("id"), root(v), "gated").select("id")


@query("k14_first_sighting_lag", "SELECT event_id AS id, (event_id % 90)::DOUBLE AS lag_minutes FROM events")
def k14(v):
    twice = K.union_feeds({"a": event_items(v), "b": event_items(v)}).withColumn("news_hash", F.col("id").cast("string"))
    return K.with_lag(K.first_sightings(twice, root(v), "sightings", "arrival"), "published_utc", "arrival").select("id", "lag_minutes")


@query(
    "k10_sliding_recency",
    "SELECT signal_id, round((epoch_us(t) - epoch_us(max(t) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING)))/3.6e9, 6) AS hours_since_prev, "
    "count(*) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN INTERVAL '86400000000' MICROSECOND PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING) AS items_prior FROM (SELECT signal_id, ticker, ts_utc AS t FROM signals_v)",
)
def k10(v):
    items = event_items(v).select(F.col("id").alias("signal_id"), "ticker", F.col("published_utc").alias("t"))
    got = K.recency_run(items, root(v), "recency", "t")
    return got.select("signal_id", F.round("hours_since_prev", 6).alias("hours_since_prev"), "items_prior")


@query(
    "k11_outcome_resolution",
    "SELECT w.signal_id, m.i IS NOT NULL AS stopped, round(CASE WHEN m.i IS NULL THEN z.close ELSE least(d.open, w.stop) END, 6) AS exit_price, epoch_us(z.ts) AS exit_us FROM wc_v w JOIN rb_v z ON z.ticker=w.ticker AND z.idx=w.exit_idx "
    "LEFT JOIN (SELECT w.signal_id, min(b.idx) AS i FROM wc_v w JOIN rb_v b ON b.ticker=w.ticker AND b.idx BETWEEN w.entry_idx AND w.exit_idx WHERE w.stop < w.entry_price AND b.low <= w.stop GROUP BY 1) m ON m.signal_id=w.signal_id LEFT JOIN rb_v d ON d.ticker=w.ticker AND d.idx=m.i",
    rb_v=RB,
    wc_v="SELECT s.signal_id, s.ticker, s.entry_price, s.stop, a.idx AS entry_idx, z.idx AS exit_idx FROM (SELECT signal_id, ticker, ts_utc, entry_price, CASE WHEN class_name IN ('Buy','Strong Buy') THEN entry_price*0.4 END AS stop FROM signals_v WHERE ts_utc <= (SELECT max(ts) FROM events) - INTERVAL '125' MINUTE AND signal_id NOT IN (SELECT doc_id FROM labels)) s "
    "ASOF JOIN rb_v a ON a.ticker=s.ticker AND a.ts >= s.ts_utc ASOF JOIN rb_v z ON z.ticker=s.ticker AND z.ts >= s.ts_utc + INTERVAL '120' MINUTE",
)
def k11(v):
    s = v.signals().withColumn("stop_price", F.when(F.col("class_name").isin("Buy", "Strong Buy"), F.col("entry_price") * 0.4))
    done = v.table("labels").select(F.col("doc_id").alias("signal_id"))
    newest = v.table("events").agg(F.max("ts")).scalar()
    o = K.resolve_outcomes(s.select("signal_id", "ticker", "ts_utc", "entry_price", "stop_price"), done, regular(v), newest)
    return o.select("signal_id", (F.col("stopped") == 1).alias("stopped"), F.round("exit_price", 6).alias("exit_price"), US("exit_ts").alias("exit_us"))


POLLS = "SELECT event_type AS ticker, ts, CASE WHEN event_id % 7 = 0 THEN 'timeout' END AS error FROM events"
CYCLES = "SELECT DISTINCT unnest(generate_series(ceil(epoch(sess_start)/120)::BIGINT, floor(epoch(sess_end)/120)::BIGINT - 1)) AS c FROM sessions_v"


def polls(v):
    s = stream(v, "events").select(F.col("event_type").alias("ticker"), "ts", F.when(F.col("event_id") % 7 == 0, "timeout").alias("error"))
    return K.polls_run(s, root(v), "polls", "ts")


@query("k12_poll_failures", "SELECT epoch_us(ts) AS ts_us, ticker, error FROM polls_v WHERE error IS NOT NULL", polls_v=POLLS)
def k12f(v):
    return polls(v)[1].select(US("ts_utc").alias("ts_us"), "ticker", "error")


@query(
    "k12_cycle_coverage",
    "SELECT u.ticker, g.n AS n_expected, coalesce(p.n, 0) AS n_polled, coalesce(p.f, 0) AS n_failed_cycles, coalesce(p.e, 0)::BIGINT AS n_failures, g.n - coalesce(p.n, 0) AS n_missing, round((g.n - coalesce(p.n, 0))::DOUBLE / g.n::DOUBLE, 9) AS missing_share "
    "FROM universe_v u, (SELECT count(*) AS n FROM cycles_v) g LEFT JOIN (SELECT ticker, count(*) AS n, count(*) FILTER (k = e) AS f, sum(e) AS e FROM (SELECT ticker, floor(epoch(ts)/120)::BIGINT AS c, count(*) AS k, count(error) AS e FROM polls_v GROUP BY 1, 2) WHERE c IN (SELECT c FROM cycles_v) GROUP BY 1) p ON p.ticker = u.ticker",
    polls_v=POLLS, cycles_v=CYCLES,
)
def k12c(v):
    c = K.cycle_coverage(polls(v)[0], K.expected_cycles(v.sessions()), v.universe())
    return c.withColumn("missing_share", F.round("missing_share", 9))


@query(
    "k12_missing_cycles",
    "SELECT ticker, epoch_us(make_timestamp(min(c)*120000000)) AS first_us, epoch_us(make_timestamp(max(c)*120000000)) AS last_us, count(*) AS n FROM (SELECT ticker, c, i - row_number() OVER (PARTITION BY ticker ORDER BY i) AS g FROM "
    "(SELECT u.ticker, x.c, x.i FROM universe_v u, (SELECT c, row_number() OVER (ORDER BY c) AS i FROM cycles_v) x WHERE NOT EXISTS (SELECT 1 FROM polls_v p WHERE p.ticker = u.ticker AND floor(epoch(p.ts)/120)::BIGINT = x.c))) GROUP BY ticker, g",
    polls_v=POLLS, cycles_v=CYCLES,
)
def k12m(v):
    m = K.missing_cycles(polls(v)[0], K.expected_cycles(v.sessions()), v.universe())
    return m.select("ticker", US("first_missing").alias("first_us"), US("last_missing").alias("last_us"), F.col("n").cast("long").alias("n"))


def files(v, df, name, n):
    """Rows as landed files for a stream, out of time order."""
    path = f"{root(v)}/{name}"
    df.repartition(n, F.xxhash64(F.lit(name), *df.columns[:2])).write.parquet(path)
    return K.item_stream(v.spark, path, K.ddl(df), "parquet", "*.parquet", files_per_batch=3)


OUT = (
    "SELECT w.signal_id, m.i IS NOT NULL AS stopped, round(CASE WHEN m.i IS NULL THEN z.close ELSE least(d.open, w.stop) END, 6) AS exit_price, epoch_us(z.ts) AS exit_us FROM wc_v w JOIN rb_v z ON z.ticker=w.ticker AND z.idx=w.exit_idx "
    "LEFT JOIN (SELECT w.signal_id, min(b.idx) AS i FROM wc_v w JOIN rb_v b ON b.ticker=w.ticker AND b.idx BETWEEN w.entry_idx AND w.exit_idx WHERE w.stop < w.entry_price AND b.low <= w.stop GROUP BY 1) m ON m.signal_id=w.signal_id LEFT JOIN rb_v d ON d.ticker=w.ticker AND d.idx=m.i"
)


@query(
    "k11_outcome_stream",
    OUT,
    rb_v=RB,
    wc_v="SELECT s.signal_id, s.ticker, s.entry_price, s.stop, a.idx AS entry_idx, z.idx AS exit_idx FROM (SELECT signal_id, ticker, ts_utc, entry_price, CASE WHEN class_name IN ('Buy','Strong Buy') THEN entry_price*0.4 END AS stop FROM signals_v WHERE ts_utc <= (SELECT max(ts) FROM rb_v) - INTERVAL '125' MINUTE) s "
    "ASOF JOIN rb_v a ON a.ticker=s.ticker AND a.ts >= s.ts_utc ASOF JOIN rb_v z ON z.ticker=s.ticker AND z.ts >= s.ts_utc + INTERVAL '120' MINUTE",
)
def k11s(v):
    """Signals and bars land as files out of order; bars that change a resolved outcome write it again."""
    s = v.signals().withColumn("stop_price", F.when(F.col("class_name").isin("Buy", "Strong Buy"), F.col("entry_price") * 0.4)).select("signal_id", "ticker", "ts_utc", "entry_price", "stop_price")
    run = K.OutcomeRun(v.spark, root(v))
    run.run(files(v, s, "signals", 3), files(v, regular(v).select("ticker", "ts", "open", "high", "low", "close", "volume"), "bars", 3))
    return run.outcomes().select("signal_id", (F.col("stopped") == 1).alias("stopped"), F.round("exit_price", 6).alias("exit_price"), US("exit_ts").alias("exit_us"))


def live_items(v):
    ev = v.table("events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("ticker"), "ts")
    docs = stream(v, "documents").join(ev, "doc_id").select(
        "ticker", F.regexp_extract("text", r"^[^.\n]*", 0).alias("headline"), F.col("text").alias("summary"), "source", F.col("ts").alias("published_utc"), F.timestamp_micros(US("ts") + (F.col("doc_id") % 90) * 60_000_000).alias("arrival")
    )
    return K.union_feeds({"feed1": docs})


def hash_scorer(df):
    """Class probabilities and severity drawn from the item's hash."""
    u = [uniform(F.concat_ws("#", F.lit(str(k)), "news_hash")) for k in range(4)]
    s = u[0] + u[1] + u[2] + u[3]
    return df.withColumns({**{f"p{k}": u[k] / s for k in range(4)}, "severity": (u[3] - u[0]) * 3})


def sharpen(df):
    """A fixed calibration: squares, renormalised."""
    q = [F.col(f"p{k}") * F.col(f"p{k}") for k in range(4)]
    s = q[0] + q[1] + q[2] + q[3]
    return df.withColumns({f"p{k}": q[k] / s for k in range(4)})


_U = "(('0x'||substr(md5('{k}#'||h),1,8))::UBIGINT/4294967295.0)"
LIVE = (
    "SELECT h, ticker, t, arrival, q0/s AS c0, q1/s AS c1, q2/s AS c2, q3/s AS c3, greatest(p0,p1,p2,p3) AS prob_raw FROM (SELECT *, q0+q1+q2+q3 AS s FROM (SELECT *, p0*p0 AS q0, p1*p1 AS q1, p2*p2 AS q2, p3*p3 AS q3 FROM (SELECT *, u0/(u0+u1+u2+u3) AS p0, u1/(u0+u1+u2+u3) AS p1, u2/(u0+u1+u2+u3) AS p2, u3/(u0+u1+u2+u3) AS p3 FROM "
    "(SELECT *, " + ", ".join(_U.format(k=k) + f" AS u{k}" for k in range(4)) + " FROM seen_v WHERE tier < 3 AND arrival <= t + INTERVAL '60' MINUTE))))"
)
SEEN = (
    "SELECT *, t + INTERVAL '1' MINUTE * (news_id % 90) AS arrival FROM (SELECT *, md5(concat_ws('|', 'feed1', ticker, headline, floor(epoch_us(published_utc)/1000000)::BIGINT)) AS h, published_utc AS t FROM tier_v) QUALIFY row_number() OVER (PARTITION BY h ORDER BY arrival) = 1"
)


@query(
    "k8_live_decision_log",
    "SELECT n.h AS news_hash, n.ticker, CASE WHEN n.c3 >= 0.5 THEN 'Strong Buy' WHEN n.c2 >= 0.5 THEN 'Buy' WHEN n.c0 = greatest(n.c0,n.c1,n.c2,n.c3) THEN 'Sell' WHEN n.c1 = greatest(n.c0,n.c1,n.c2,n.c3) THEN 'Neutral' WHEN n.c2 = greatest(n.c0,n.c1,n.c2,n.c3) THEN 'Buy' ELSE 'Strong Buy' END AS class_name, "
    "CASE WHEN n.c3 >= 0.5 OR n.c2 >= 0.5 THEN 'fired' ELSE 'silent' END AS status, round(CASE WHEN n.c3 >= 0.5 THEN n.c3 WHEN n.c2 >= 0.5 THEN n.c2 ELSE greatest(n.c0,n.c1,n.c2,n.c3) END, 8) AS prob_calibrated, round(n.prob_raw, 8) AS prob_raw, round(b.close, 6) AS entry_price, "
    "round((epoch_us(n.t) - epoch_us(r.prev))/3.6e9, 6) AS hours_since_prev, r.k AS items_prior FROM live_v n ASOF JOIN he_v x ON x.ticker = n.ticker AND x.hour_end < n.t JOIN (SELECT n.h, max(a.arrival) FILTER (a.arrival < n.t) AS prev, count(*) FILTER (a.arrival < n.t AND a.arrival >= n.t - INTERVAL '24' HOUR) AS k FROM live_v n LEFT JOIN seen_v a ON a.ticker = n.ticker GROUP BY 1) r ON r.h = n.h "
    "JOIN (SELECT n.h, b.close FROM live_v n ASOF JOIN rb_v b ON b.ticker = n.ticker AND b.ts <= n.arrival) b ON b.h = n.h",
    rb_v=RB, tier_v=TIER, seen_v=SEEN, live_v=LIVE, he_v="SELECT * FROM (SELECT ticker, ts + INTERVAL '1' HOUR AS hour_end, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n FROM (SELECT DISTINCT ticker, date_trunc('hour', ts) AS ts FROM rb_v)) WHERE n >= 30",
)
def k8(v):
    """The whole live path (K1, K4-K8) over the documents as a stream, with a scorer that draws from hashes and a fixed
    calibration."""
    edges = L.threshold_edges(pool(v)[1], "score").first().edges
    run = K.LiveRun(v.spark, root(v), regular(v), v.sessions(), X.matchers(profiled(v)), hash_scorer, {"Strong Buy": 0.5, "Buy": 0.5}, (edges[0], edges[-1]), calibrate=sharpen)
    run.run(live_items(v))
    log = v.spark.read.parquet(f"{run.root}/decision_log")
    return log.select("news_hash", "ticker", "class_name", "status", F.round("prob_calibrated", 8).alias("prob_calibrated"), F.round("prob_raw", 8).alias("prob_raw"), F.round("entry_price", 6).alias("entry_price"), F.round("hours_since_prev", 6).alias("hours_since_prev"), "items_prior")


def live_state(v, days):
    """Feature state over all bars, folded up to the newest `days` days, the items of those days, and the days."""
    newest = v.table("events").agg(F.max(F.to_date("ts")).alias("d")).first().d
    live = [newest - dt.timedelta(days=k) for k in reversed(range(days))]
    bench = v.bench().select(F.date_add("d", 9131).alias("d"), "c")
    state = FeatureState(v.spark, root(v), v.sessions(), bench, v.universe(), FRAME)
    state.add_bars(v.bars().withColumn("volume", F.col("volume").cast("long")), 0)
    s = v.signals().filter(F.to_date("ts_utc") >= F.lit(live[0])).select(F.col("signal_id").cast("string").alias("news_hash"), "ticker", F.col("ts_utc").alias("published_utc"), F.when(F.col("n_symbols") == 1, "earnings").otherwise("other").alias("news_type"), *[F.lit(0.25).alias(c) for c in R.SENTIMENT])
    return state, v.keep(s), bench, live


def live_frames(v, state, items, live):
    out = None
    for day in live:
        mine = items.filter(F.to_date("published_utc") == F.lit(day))
        flow = mine.select("news_hash", F.lit(None).cast("double").alias("hours_since_prev"), F.lit(0).alias("items_prior"))
        frame = state.frame(mine, day, flow)
        out = frame if out is None else out.unionByName(frame)
    return out


FRAME = R.expected_columns(["A", "B"], ["earnings", "other"])


@query(
    "k6_live_frame",
    "SELECT s.signal_id, round(h.rsi,6) AS rsi, round(h.macd_hist,7) AS macd_hist, round(h.bb_pctb,6) AS bb_pctb, round(h.bb_width,6) AS bb_width, round(h.atr_pct,6) AS atr_pct, d.dist_from_vwap, round(b.dist_sma_fast,7) AS dist_sma_fast, b.above_slow::DOUBLE AS above_slow, "
    "round(CASE WHEN a.k >= 30 THEN a.sd END,7) AS sigma, round(extract(hour FROM s.l) + extract(minute FROM s.l)/60.0::DOUBLE, 6) AS et_hour, (u.sector='A')::INT::DOUBLE AS sect_a, (s.n_symbols=1)::INT::DOUBLE AS nt_earnings "
    "FROM (SELECT *, ts_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l, CAST(ts_utc AS DATE) AS dd FROM signals_v WHERE CAST(ts_utc AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 1) s ASOF JOIN he_v h ON h.ticker=s.ticker AND h.hour_end < s.ts_utc JOIN vws_v d ON d.signal_id=s.signal_id "
    "JOIN universe_v u ON u.ticker=s.ticker ASOF LEFT JOIN br9_v b ON b.d < s.dd ASOF LEFT JOIN sd_v a ON a.ticker=s.ticker AND a.end_ts < s.ts_utc",
    **H, he_v=HE, vw_v=VW, vws_v=VWS, br_v=BR, br9_v="SELECT d + 9131 AS d, dist_sma_fast, dist_sma_slow, above_slow FROM br_v",
    anch_v=ANCH.replace("rb_v", "bars_v"), sd_v="SELECT ticker, end_ts, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS k FROM anch_v WINDOW w AS (PARTITION BY ticker ORDER BY end_ts)",
)
def k6(v):
    """The live frame of the two newest days' items. All earlier days' bars are folded, one carry before the first of them."""
    state, items, _, live = live_state(v, 2)
    f = live_frames(v, state, items, live)
    cols = [F.round(c, n).alias(c) for c, n in (("rsi", 6), ("macd_hist", 7), ("bb_pctb", 6), ("bb_width", 6), ("atr_pct", 6), ("dist_from_vwap", 8), ("dist_sma_fast", 7))]
    return f.select(F.col("news_hash").cast("long").alias("signal_id"), *cols, "above_slow", F.round("sigma", 7).alias("sigma"), F.round("et_hour", 6).alias("et_hour"), F.col("sect_A").alias("sect_a"), "nt_earnings")


@query(
    "f25_live_and_batch_parity",
    "SELECT s.ticker, count(*) AS n, 'OK' AS flag FROM (SELECT * FROM signals_v WHERE CAST(ts_utc AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) s ASOF JOIN he_v h ON h.ticker=s.ticker AND h.hour_end < s.ts_utc GROUP BY 1",
    he_v="SELECT *, ts + INTERVAL '1' HOUR AS hour_end FROM hn_v WHERE n >= 30", hour_v=HOURLY, hn_v=HN,
)
def f25_two(v):
    """Two builds of the newest day's features: from the folded state, and from all bars at once."""
    state, items, bench, live = live_state(v, 1)
    none = v.spark.createDataFrame([], "ticker string, nt timestamp")
    batch = R.feature_frame(items, v.keep(v.bars()), v.sessions(), bench, v.universe(), none, FRAME)
    return L.parity(live_frames(v, state, items, live), batch, "news_hash", FRAME, "ticker").select("ticker", "n", "flag")
