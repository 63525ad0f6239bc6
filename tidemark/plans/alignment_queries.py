"""Registered queries: alignment of events to sessions, bars and outcomes."""

from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.plans.registry import query
from tidemark.sources.testviews import Views

RB = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS idx FROM sess_bars_v"


def _ev_sql(n: int) -> str:
    """Aligned events with exit `n` bars later."""
    return (
        "SELECT n.*, b.ts AS entry_ts, b.idx AS entry_idx, b.open AS entry_price, b.exit_ts, b.exit_price, "
        "CAST(floor(epoch_us(b.ts)/1e6 - epoch_us(CASE WHEN s.sess_start IS NOT NULL THEN n.published_utc ELSE b.sess_start END)/1e6) AS BIGINT) AS delay_sec, "
        "b.exit_price/b.open - 1 AS fwd_ret "
        "FROM news_v n ASOF JOIN (SELECT *, lead(ts,%d) OVER (PARTITION BY ticker ORDER BY ts) AS exit_ts, "
        "lead(close,%d) OVER (PARTITION BY ticker ORDER BY ts) AS exit_price FROM rb_v) b "
        "ON n.ticker = b.ticker AND b.ts >= n.published_utc "
        "LEFT JOIN sessions_v s ON n.published_utc >= s.sess_start AND n.published_utc < s.sess_end "
        "WHERE (s.sess_start IS NULL OR s.sess_start = b.sess_start) "
        "AND epoch_us(b.ts) - epoch_us(CASE WHEN s.sess_start IS NOT NULL THEN n.published_utc ELSE b.sess_start END) BETWEEN 0 AND 900000000 "
        "AND b.open > 0 AND b.exit_price > 0"
    ) % (n, n)


V = {"rb_v": RB, "ev5_v": _ev_sql(5), "ev120_v": _ev_sql(120)}
US = F.unix_micros


def regular(v: Views):
    return A.regular_bars(v.bars(), v.sessions())


def events(v: Views, n: int):
    return A.compute_events(v.news(), v.bars(), v.sessions(), horizon=n)


@query(
    "entry_event_returns",
    "SELECT ticker, count(*) AS n, round(avg(fwd_ret),6) AS mean_ret, round(avg(delay_sec),6) AS mean_delay_sec FROM ev5_v GROUP BY 1",
    **V,
)
def entry_event_returns(v):
    return events(v, 5).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd_ret"), 6).alias("mean_ret"), F.round(F.avg("delay_sec"), 6).alias("mean_delay_sec")
    )


@query(
    "d1_asof_forward_entry",
    "SELECT n.news_id, epoch_us(b.ts) AS entry_us, b.open FROM news_v n ASOF LEFT JOIN rb_v b ON n.ticker=b.ticker AND b.ts >= n.published_utc",
    **V,
)
def d1(v):
    e = A.entry_bar(v.news().select("news_id", "ticker", "published_utc"), regular(v), "published_utc", ["ts", "open"])
    return e.select("news_id", US("bar.ts").alias("entry_us"), F.col("bar.open").alias("open"))


@query(
    "d2_session_containing",
    "SELECT e.event_id, epoch_us(s.sess_start) AS start_us FROM events e LEFT JOIN sessions_v s ON e.ts >= s.sess_start AND e.ts < s.sess_end",
)
def d2(v):
    return A.with_session(v.table("events").select("event_id", "ts"), "ts", v.sessions()).select(
        "event_id", US("sess_start").alias("start_us")
    )


@query(
    "d3_after_hours_roll",
    "SELECT n.news_id, epoch_us(CASE WHEN s.sess_start IS NOT NULL THEN n.published_utc ELSE b.sess_start END) AS anchor_us FROM news_v n "
    "ASOF JOIN rb_v b ON n.ticker=b.ticker AND b.ts >= n.published_utc LEFT JOIN sessions_v s ON n.published_utc >= s.sess_start AND n.published_utc < s.sess_end "
    "WHERE s.sess_start IS NULL OR s.sess_start = b.sess_start",
    **V,
)
def d3(v):
    e = A.entry_bar(A.with_session(v.news(), "published_utc", v.sessions()), regular(v), "published_utc", ["ts", "sess_start"])
    return A.anchor_entries(e, "published_utc").select("news_id", US("anchor_ts").alias("anchor_us"))


@query(
    "d4_delay_gate",
    "SELECT news_id, CAST(d // 1000000 AS BIGINT) AS delay_sec FROM (SELECT n.news_id, epoch_us(b.ts) - epoch_us(CASE WHEN s.sess_start IS NOT NULL THEN n.published_utc "
    "ELSE b.sess_start END) AS d FROM news_v n ASOF JOIN rb_v b ON n.ticker=b.ticker AND b.ts >= n.published_utc LEFT JOIN sessions_v s "
    "ON n.published_utc >= s.sess_start AND n.published_utc < s.sess_end WHERE s.sess_start IS NULL OR s.sess_start = b.sess_start) WHERE d BETWEEN 0 AND 900000000",
    **V,
)
def d4(v):
    e = A.entry_bar(A.with_session(v.news(), "published_utc", v.sessions()), regular(v), "published_utc", ["ts", "sess_start"])
    return A.delay_gate(A.anchor_entries(e, "published_utc")).select("news_id", "delay_sec")


@query(
    "d5_exit_n_bars_later",
    "SELECT a.ticker, epoch_us(a.ts) AS ts_us, a.open AS entry_price, epoch_us(z.ts) AS exit_us, z.close AS exit_price FROM rb_v a JOIN rb_v z "
    "ON z.ticker=a.ticker AND z.idx=a.idx+120 WHERE a.open > 0 AND z.close > 0",
    **V,
)
def d5(v):
    b = A.with_exit(regular(v)).filter("open > 0 AND exit_price > 0")
    return b.select("ticker", US("ts").alias("ts_us"), F.col("open").alias("entry_price"), US("exit_ts").alias("exit_us"), "exit_price")


@query(
    "d6_event_builder",
    "SELECT news_id, ticker, epoch_us(entry_ts) AS entry_us, delay_sec, entry_price, epoch_us(exit_ts) AS exit_us, exit_price, round(fwd_ret,9) AS fwd_ret FROM ev120_v",
    **V,
)
def d6(v):
    return events(v, 120).select(
        "news_id", "ticker", US("entry_ts").alias("entry_us"), "delay_sec", "entry_price", US("exit_ts").alias("exit_us"),
        "exit_price", F.round("fwd_ret", 9).alias("fwd_ret"),
    )


BENCH_SQL = "SELECT n.signal_id, n.ts_utc AS t0, n.ts_utc + INTERVAL '120' MINUTE AS t1, n.ticker FROM signals_v n"


@query(
    "d11_window_return",
    "SELECT w.signal_id, round(CASE WHEN z.ts >= a.ts THEN z.close/a.open - 1 END, 9) AS ret FROM w_v w ASOF LEFT JOIN bars_v a "
    "ON a.ticker=w.ticker AND a.ts >= w.t0 ASOF LEFT JOIN bars_v z ON z.ticker=w.ticker AND z.ts < w.t1",
    w_v=BENCH_SQL,
)
def d11(v):
    s = v.signals().select("signal_id", "ticker", F.col("ts_utc").alias("t0"), A.after("ts_utc", 120).alias("t1"))
    return A.window_returns(s, v.bars()).select("signal_id", F.round("ret", 9).alias("ret"))


@query(
    "d12_universe_window_returns",
    "SELECT epoch_us(r.t0) AS t0_us, r.ticker, round(r.ret,9) AS ret, round(r.ret - b.ret,9) AS adj FROM r_v r JOIN r_v b ON b.t0=r.t0 AND b.ticker='view'",
    r_v="SELECT w.t0, u.ticker, CASE WHEN z.ts >= a.ts THEN z.close/a.open - 1 END AS ret FROM (SELECT DISTINCT ts_utc AS t0, ts_utc + INTERVAL '120' MINUTE AS t1 "
    "FROM signals_v WHERE status='fired') w CROSS JOIN universe_v u ASOF LEFT JOIN bars_v a ON a.ticker=u.ticker AND a.ts >= w.t0 ASOF LEFT JOIN bars_v z ON z.ticker=u.ticker AND z.ts < w.t1",
)
def d12(v):
    w = v.signals().filter("status = 'fired'").select(F.col("ts_utc").alias("t0"), A.after("ts_utc", 120).alias("t1"))
    r = A.universe_returns(w, v.bars(), v.universe(), "view")
    return r.select(US("t0").alias("t0_us"), "ticker", F.round("ret", 9).alias("ret"), F.round("adj", 9).alias("adj"))


@query(
    "d13_clip_to_session",
    "SELECT s.signal_id, epoch_us(least(s.ts_utc + INTERVAL '120' MINUTE, x.sess_end)) AS t1_us FROM signals_v s JOIN sessions_v x ON s.ts_utc >= x.sess_start AND s.ts_utc < x.sess_end",
)
def d13(v):
    s = A.with_session(v.signals(), "ts_utc", v.sessions(), "inner")
    return A.clip_to_session(s, "ts_utc", "sess_end").select("signal_id", US("t1").alias("t1_us"))


# ---- daily event study ---------------------------------------------------------------------------
PATH = (
    "SELECT *, min(CASE WHEN gap_next > 25 THEN idx END) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS halt_idx FROM ("
    "SELECT *, row_number() OVER w AS idx, date_diff('day', lag(d) OVER w, d) AS gap, date_diff('day', d, lead(d) OVER w) AS gap_next, "
    "count(*) OVER (PARTITION BY ticker) AS last_idx FROM daily_v WINDOW w AS (PARTITION BY ticker ORDER BY d))"
)
STUDY_EV = "SELECT accession, concat('S', issuer) AS ticker, filing_date FROM filings_v WHERE document_type = '4'"
STUDY = (
    "SELECT y.accession, y.ticker, y.filing_date, y.h, y.entry_date, y.entry_price, x.d AS exit_date, x.c AS exit_price, y.truncated, x.c/y.entry_price - 1 AS ret FROM ("
    "SELECT e.accession, e.ticker, e.filing_date, h.h, p.d AS entry_date, p.c AS entry_price, coalesce(p.idx + h.h > p.halt_idx, false) OR p.idx + h.h > p.last_idx AS truncated, "
    "CASE WHEN coalesce(p.idx + h.h > p.halt_idx, false) THEN p.halt_idx ELSE least(p.idx + h.h, p.last_idx) END AS xi "
    "FROM study_ev_v e ASOF JOIN path_v p ON p.ticker=e.ticker AND p.d > e.filing_date CROSS JOIN (VALUES (5),(20),(60)) h(h)) y JOIN path_v x ON x.ticker=y.ticker AND x.idx=y.xi"
)
BENCHN = "SELECT *, row_number() OVER (ORDER BY d) AS i FROM bench_v"
SV = {"path_v": PATH, "study_ev_v": STUDY_EV, "study_v": STUDY, "benchn_v": BENCHN}


def study_events(v: Views):
    return v.filings().filter("document_type = '4'").select("accession", F.concat(F.lit("S"), "issuer").alias("ticker"), "filing_date")


def study(v: Views):
    path = A.daily_path(v.daily(), 25)
    return A.study_exits(A.study_entries(study_events(v), path, "filing_date"), path)


@query(
    "d14_daily_entry_exit",
    "SELECT accession, h, entry_date, round(entry_price,8) AS entry_price, exit_date, round(ret,6) AS ret FROM study_v",
    **SV,
)
def d14(v):
    return study(v).select("accession", "h", "entry_date", F.round("entry_price", 8).alias("entry_price"), "exit_date", F.round("ret", 6).alias("ret"))


@query("d15_halt_gap_truncation", "SELECT ticker, h, count(*) AS n, sum(truncated::INT)::BIGINT AS n_truncated FROM study_v GROUP BY 1,2", **SV)
def d15(v):
    return study(v).groupBy("ticker", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("n_truncated"))


@query(
    "d16_benchmark_between",
    "SELECT s.accession, s.h, round(CASE WHEN z.i > a.i THEN z.c/a.c - 1 END, 6) AS bench_ret FROM study_v s ASOF LEFT JOIN benchn_v a ON a.d >= s.entry_date ASOF LEFT JOIN benchn_v z ON z.d <= s.exit_date",
    **SV,
)
def d16(v):
    return A.bench_between(study(v), v.bench(), "entry_date", "exit_date").select("accession", "h", F.round("bench_ret", 6).alias("bench_ret"))


ACT = "SELECT ticker, strftime(max(d), '%Y-%m-%d') AS ex_date, 'spin_off' AS type FROM (SELECT event_type AS ticker, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('click','view') AND value > 200) GROUP BY 1"


def spin_offs(v: Views):
    e = v.table("events").filter("event_type IN ('click','view') AND value > 200")
    return e.groupBy(F.col("event_type").alias("ticker")).agg(F.date_format(F.max(F.to_date("ts")), "yyyy-MM-dd").alias("ex_date")).withColumn("type", F.lit("spin_off"))


@query(
    "d17_corporate_action_suppression",
    "SELECT s.ticker, count(*) AS n, sum(CASE WHEN s.ts_utc < u.until_ts THEN 1 ELSE 0 END)::BIGINT AS n_suppressed, epoch_us(any_value(u.until_ts)) AS until_us FROM signals_v s LEFT JOIN u_v u ON u.ticker=s.ticker GROUP BY 1",
    act_v=ACT,
    cal_v="SELECT sess_start, row_number() OVER (ORDER BY sess_start) AS i, count(*) OVER () AS n FROM sessions_v",
    u_v="SELECT a.ticker, max(z.sess_start) AS until_ts FROM (SELECT a.ticker, least(coalesce(min(c.i)+60, (SELECT max(n) FROM cal_v)), (SELECT max(n) FROM cal_v)) AS i FROM act_v a LEFT JOIN cal_v c ON c.sess_start >= CAST(a.ex_date AS TIMESTAMP) GROUP BY a.ticker, a.ex_date) a "
    "JOIN cal_v z ON z.i=a.i GROUP BY 1",
)
def d17(v):
    s = A.suppress(v.signals(), A.suppressed_until(spin_offs(v), v.sessions()))
    return s.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if("suppressed").alias("n_suppressed"), US(F.max("until_ts")).alias("until_us"))


@query(
    "d18_pending_outcomes",
    "SELECT signal_id, ticker, entry_price FROM signals_v s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.signal_id) AND ts_utc <= (SELECT max(ts) FROM events) - INTERVAL '125' MINUTE",
)
def d18(v):
    newest = v.table("events").agg(A.after(F.max("ts"), -125)).scalar()
    done = v.table("labels").select(F.col("doc_id").alias("signal_id"))
    return A.pending_outcomes(v.signals(), done, newest).select("signal_id", "ticker", "entry_price")


@query(
    "d19_outcome_upsert",
    "SELECT user_id AS signal_id, epoch_us(max(ts)) AS filled_us, max_by(value, ts) AS ret FROM events GROUP BY 1",
)
def d19(v):
    rows = v.table("events").select(F.col("user_id").alias("signal_id"), F.col("value").alias("ret"), F.col("ts").alias("filled_at"), "event_type")
    current, incoming = rows.filter("event_type <> 'view'").drop("event_type"), rows.filter("event_type = 'view'").drop("event_type")
    return A.upsert_outcomes(current, incoming).select("signal_id", US("filled_at").alias("filled_us"), "ret")


@query(
    "d20_semi_join_reduction",
    "SELECT accession, count(*) AS n_lines, round(sum(shares*price),4) AS dollars FROM filing_lines_v WHERE trans_code='P' AND accession IN (SELECT accession FROM filings_v WHERE document_type='4') GROUP BY 1",
)
def d20(v):
    ok = v.filings().filter("document_type = '4'").select("accession")
    lines = v.filing_lines().filter("trans_code = 'P'").join(ok, "accession", "left_semi")
    return lines.groupBy("accession").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("shares") * F.col("price")), 4).alias("dollars"))


@query(
    "d21_eligible_days",
    "SELECT p.ticker, p.d, NOT EXISTS (SELECT 1 FROM study_ev_v e WHERE e.ticker=p.ticker AND e.filing_date BETWEEN p.d - 30 AND p.d + 30) AS eligible FROM daily_v p",
    **SV,
)
def d21(v):
    return A.eligible_days(v.daily().select("ticker", "d"), study_events(v), "d", "filing_date").select("ticker", "d", "eligible")


@query(
    "d22_latency_grid",
    "SELECT delay_min, ticker, count(*) AS n, round(avg(r),6) AS mean_ret, round(avg((r>0)::INT),6) AS win FROM (SELECT n.delay_min, n.ticker, b.exit_price/b.open - 1 AS r "
    "FROM (SELECT n.ticker, x.delay_min, n.published_utc + INTERVAL '1' MINUTE * x.delay_min AS t FROM news_v n CROSS JOIN (VALUES (0),(1),(4),(15),(43)) x(delay_min)) n "
    "ASOF JOIN xb_v b ON b.ticker=n.ticker AND b.ts >= n.t WHERE b.open > 0 AND b.exit_price > 0) GROUP BY 1,2",
    rb_v=RB,
    xb_v="SELECT *, lead(ts,120) OVER (PARTITION BY ticker ORDER BY ts) AS exit_ts, lead(close,120) OVER (PARTITION BY ticker ORDER BY ts) AS exit_price FROM rb_v",
)
def d22(v):
    g = A.latency_grid(v.news().select("news_id", "ticker", "published_utc"), v.bars(), v.sessions())
    return g.groupBy("delay_min", "ticker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd_ret"), 6).alias("mean_ret"),
        F.round(F.avg((F.col("fwd_ret") > 0).cast("int")), 6).alias("win"),
    )


H32 = "('0x'||substr(md5({x}),1,8))::UBIGINT::BIGINT"


@query(
    "d23_placebo_points",
    "SELECT d.news_id, d.k, d.matched_hour, epoch_us(p.ts) AS placebo_us FROM draw_v d JOIN pool_v p ON p.ticker=d.ticker AND CASE WHEN d.matched_hour THEN p.hr = d.hr AND p.rh = d.r ELSE p.ra = d.r END",
    rb_v=RB,
    quiet_v="SELECT b.ticker, b.ts, extract(hour FROM b.ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS hr, "
    + H32.format(x="concat_ws('|','placebo',b.ticker,epoch_us(b.ts))")
    + " AS hh FROM rb_v b WHERE NOT EXISTS (SELECT 1 FROM news_v n WHERE n.ticker=b.ticker AND n.published_utc BETWEEN b.ts - INTERVAL '2' HOUR AND b.ts + INTERVAL '2' HOUR)",
    pool_v="SELECT *, row_number() OVER (PARTITION BY ticker, hr ORDER BY hh, ts) AS rh, row_number() OVER (PARTITION BY ticker ORDER BY hh, ts) AS ra FROM quiet_v",
    draw_v="SELECT n.news_id, n.ticker, n.hr, k.k, h.nh IS NOT NULL AS matched_hour, ((n.j-1)*3 + k.k - 1) % coalesce(h.nh, a.na) + 1 AS r FROM (SELECT news_id, ticker, hr, row_number() OVER (PARTITION BY ticker, hr ORDER BY published_utc, news_id) AS j "
    "FROM (SELECT *, extract(hour FROM published_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS hr FROM news_v)) n LEFT JOIN (SELECT ticker, hr, count(*) AS nh FROM pool_v GROUP BY 1,2) h ON h.ticker=n.ticker AND h.hr=n.hr "
    "JOIN (SELECT ticker, count(*) AS na FROM pool_v GROUP BY 1) a ON a.ticker=n.ticker CROSS JOIN (VALUES (1),(2),(3)) k(k) WHERE k.k <= coalesce(h.nh, a.na)",
)
def d23(v):
    n = v.news().select("news_id", "ticker", "published_utc")
    p = A.placebo_points(n, regular(v), n, "published_utc")
    return p.select("news_id", F.col("k").cast("int").alias("k"), "matched_hour", US("placebo_ts").alias("placebo_us"))


@query(
    "d24_exit_margin_bands",
    "SELECT CASE WHEN h <= 0 THEN 'unresolved' WHEN h <= 24 THEN '<1d' WHEN h <= 72 THEN '1-3d' WHEN h <= 168 THEN '3-7d' ELSE '>7d' END AS margin_band, count(*) AS n FROM "
    "(SELECT (epoch_us(l.m) - epoch_us(s.ts_utc + INTERVAL '120' MINUTE))/3.6e9 AS h FROM signals_v s JOIN (SELECT ticker, max(ts) AS m FROM rb_v GROUP BY 1) l ON l.ticker=s.ticker) GROUP BY 1",
    rb_v=RB,
)
def d24(v):
    s = v.signals().withColumn("exit_ts", A.after("ts_utc", 120))
    return A.exit_margin(s, regular(v)).groupBy("margin_band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d25_price_fallback",
    "SELECT s.signal_id, CASE WHEN s.live > 0 THEN s.live ELSE b.close END AS entry_price, CASE WHEN s.live > 0 THEN 'live_trade' ELSE 'last_regular_close_proxy' END AS entry_source FROM "
    "(SELECT signal_id, ticker, arrival, CASE WHEN class_name = 'Sell' THEN NULL WHEN class_name='Neutral' THEN 0 ELSE entry_price END AS live FROM signals_v) s ASOF LEFT JOIN rb_v b ON b.ticker=s.ticker AND b.ts <= s.arrival "
    "WHERE s.live > 0 OR b.close IS NOT NULL",
    rb_v=RB,
)
def d25(v):
    live = F.when(F.col("class_name") == "Sell", F.lit(None)).when(F.col("class_name") == "Neutral", 0.0).otherwise(F.col("entry_price"))
    s = v.signals().select("signal_id", "ticker", "arrival", live.cast("double").alias("live"))
    return A.entry_price_with_fallback(s, regular(v), "live", "arrival").select("signal_id", "entry_price", "entry_source")
