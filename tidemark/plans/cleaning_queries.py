"""Registered queries: cleaning, identity and de-duplication."""

from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.operators.align import after
from tidemark.plans.registry import query

US = F.unix_micros
NORM = "trim(regexp_replace(lower({h}),'[^a-z0-9]+',' ','g'))"
N_HEAD = NORM.format(h="headline")


@query("b1_normalize_headline", f"SELECT doc_id, md5({NORM.format(h='text')}) AS norm_md5, length({NORM.format(h='text')})::INT AS norm_len FROM documents")
def b1(v):
    n = C.normalize_headline("text")
    return v.table("documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_len"))


@query("b2_drop_incomplete", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.source IS NOT NULL")
def b2(v):
    j = v.table("documents").join(v.table("labels"), "doc_id", "left")
    return C.drop_incomplete(j, "quality", "source").select("doc_id", "quality")


@query("b3_epoch_to_timestamp", "SELECT event_id, epoch_us(to_timestamp(epoch_us(ts)//1000000)) AS us FROM events")
def b3(v):
    e = v.table("events").select("event_id", F.unix_seconds("ts").alias("epoch"))
    return e.select("event_id", US(F.timestamp_seconds("epoch")).alias("us"))


# News by minute-of-story: texts repeat across documents, so cleaning runs on a denser feed as well.
FEED = "SELECT event_id AS news_id, event_type AS ticker, concat(CASE WHEN value < 20 THEN 'Low' ELSE 'High' END, ' value, user ', user_id % 3) AS headline, ts AS published_utc FROM events"


def feed(v):
    return v.table("events").select(
        F.col("event_id").alias("news_id"), F.col("event_type").alias("ticker"),
        F.concat(F.when(F.col("value") < 20, "Low").otherwise("High"), F.lit(" value, user "), F.col("user_id") % 3).alias("headline"),
        F.col("ts").alias("published_utc"),
    )


NEAR = (
    "SELECT news_id FROM (SELECT news_id, published_utc, substr({n},1,48) AS k, lag(substr({n},1,48)) OVER w AS pk, lag(published_utc) OVER w AS pt "
    "FROM {t} WINDOW w AS (PARTITION BY ticker ORDER BY published_utc, news_id)) WHERE k = pk AND published_utc - pt <= INTERVAL '10' MINUTE"
)
FIRST = "SELECT news_id FROM (SELECT news_id, row_number() OVER (PARTITION BY ticker, {n} ORDER BY published_utc, news_id) AS rn FROM {t}) WHERE rn = 1"


@query("b4_near_duplicates", NEAR.format(n=N_HEAD, t="feed_v"), feed_v=FEED)
def b4(v):
    return C.near_duplicates(feed(v), "published_utc", "news_id")


@query("b5_exact_duplicates_first", FIRST.format(n=N_HEAD, t="news_v"))
def b5(v):
    return C.first_copies(v.news(), "published_utc", "news_id")


@query(
    "b5_dedupe_news",
    f"SELECT news_id, ticker FROM feed_v WHERE news_id NOT IN ({NEAR.format(n=N_HEAD, t='feed_v')}) AND news_id IN ({FIRST.format(n=N_HEAD, t='feed_v')})",
    feed_v=FEED,
)
def b5_both(v):
    return C.dedupe_news(feed(v), "published_utc", "news_id").select("news_id", "ticker")


@query("b6_dedupe_bars", "SELECT event_type AS ticker, epoch_us(date_trunc('minute', ts)) AS ts_us, arg_min(value, event_id) AS close FROM events GROUP BY 1,2")
def b6(v):
    raw = v.table("events").select(F.col("event_type").alias("ticker"), F.date_trunc("minute", "ts").alias("ts"), F.col("value").alias("close"), "event_id")
    return C.dedupe_bars(raw, "event_id").select("ticker", US("ts").alias("ts_us"), "close")


@query("b7_drop_zero_volume", "SELECT ticker, epoch_us(ts) AS ts_us, volume - 1 AS extra FROM bars_v WHERE volume - 1 > 0")
def b7(v):
    b = v.bars().withColumn("extra", F.col("volume") - 1)
    return C.drop_zero_volume(b, "extra").select("ticker", US("ts").alias("ts_us"), "extra")


@query("b8_regular_session_bars", "SELECT ticker, epoch_us(ts) AS ts_us, close FROM sess_bars_v")
def b8(v):
    return C.regular_minutes(v.bars(), v.sessions()).select("ticker", US("ts").alias("ts_us"), "close")


@query("b9_content_hash", "SELECT news_id, md5(concat_ws('|', source, ticker, headline, epoch_us(published_utc)//1000000)) AS news_hash FROM news_v")
def b9(v):
    return v.news().select("news_id", C.news_hash(F.col("source"), F.col("ticker"), F.col("headline"), F.unix_seconds("published_utc")).alias("news_hash"))


@query(
    "b10_story_group",
    "SELECT event_id, substr(md5(concat_ws('|', event_type, strftime(time_bucket(INTERVAL '15' MINUTE, ts), '%Y-%m-%dT%H:%M:%S') || '+00:00')),1,12) AS group_id FROM events",
)
def b10(v):
    return v.table("events").select("event_id", C.story_group(F.col("event_type"), "ts").alias("group_id"))


@query(
    "b11_event_id",
    "SELECT event_id AS src_id, concat_ws('_', ticker, ep, row_number() OVER (PARTITION BY ticker, ep ORDER BY event_id) - 1) AS event_id FROM (SELECT event_id, event_type AS ticker, epoch_us(date_trunc('hour', ts))//1000000 AS ep FROM events)",
)
def b11(v):
    e = v.table("events").select(F.col("event_id").alias("src_id"), F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("t"))
    return C.with_event_id(e, "t", "src_id").select("src_id", "event_id")


@query(
    "b12_pair_kth_duplicate",
    "SELECT a.signal_id, l.arrival_us FROM (SELECT *, row_number() OVER (PARTITION BY ticker, class_name, u ORDER BY signal_id) AS k FROM (SELECT *, CASE WHEN n_symbols=0 THEN '' ELSE news_source END AS u FROM signals_v)) a "
    "LEFT JOIN (SELECT *, epoch_us(arrival) AS arrival_us, row_number() OVER (PARTITION BY ticker, class_name, u ORDER BY signal_id) AS k FROM (SELECT *, CASE WHEN n_symbols=0 THEN '' ELSE news_source END AS u FROM signals_v WHERE status='silent')) l "
    "ON l.ticker=a.ticker AND l.class_name=a.class_name AND l.u=a.u AND l.k=a.k",
)
def b12(v):
    s = v.signals().withColumn("u", F.when(F.col("n_symbols") != 0, F.col("news_source")))
    log = s.filter("status = 'silent'").withColumn("arrival_us", US("arrival"))
    return C.pair_kth(s, log, ["ticker", "class_name", "u"], "signal_id", "signal_id", ["arrival_us"]).select("signal_id", "arrival_us")


@query(
    "b13_redact_secrets",
    "SELECT doc_id, md5(replace(replace(text, 'the', '***REDACTED_FEED_KEY***'), 'and', '***REDACTED_BOT_TOKEN***')) AS masked_md5 FROM documents",
)
def b13(v):
    return v.table("documents").select("doc_id", F.md5(C.redact("text", {"FEED_KEY": "the", "BOT_TOKEN": "and", "UNSET": ""})).alias("masked_md5"))


NAMES_SQL = (
    "SELECT s_suppkey, concat(s_name, CASE s_nationkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' & Co /DE/' WHEN 2 THEN ' Holdings Corp' WHEN 3 THEN ' Limited' ELSE '''s LLC' END) AS name FROM supplier"
)


def company_names(v):
    n = F.col("s_nationkey") % 5
    tail = F.when(n == 0, ", Inc.").when(n == 1, " & Co /DE/").when(n == 2, " Holdings Corp").when(n == 3, " Limited").otherwise("'s LLC")
    return v.table("supplier").select("s_suppkey", F.concat("s_name", tail).alias("name"))


@query(
    "b14_normalize_company",
    r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(name), '[.,''&]', ' ', 'g'), '\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|LLC|LP|PLC|THE)\b|/(DE|MD|NEW|VA)/', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name_norm FROM names_v",
    names_v=NAMES_SQL,
)
def b14(v):
    return company_names(v).select("s_suppkey", C.normalize_company("name").alias("name_norm"))


SYM_SQL = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NYSE: T' || o_custkey WHEN 1 THEN ' nasdaq/T' || o_custkey || ' ' WHEN 2 THEN 'T' || o_custkey || ', T' || o_orderkey WHEN 3 THEN 'T' || o_custkey || '/B' ELSE 'T' || o_custkey END AS symbol FROM orders"


def symbols(v):
    k, c = F.col("o_orderkey") % 5, F.concat(F.lit("T"), "o_custkey")
    s = (
        F.when(k == 0, F.concat(F.lit("NYSE: "), c)).when(k == 1, F.concat(F.lit(" nasdaq/"), c, F.lit(" ")))
        .when(k == 2, F.concat(c, F.lit(", T"), "o_orderkey")).when(k == 3, F.concat(c, F.lit("/B"))).otherwise(c)
    )
    return v.table("orders").select("o_orderkey", s.alias("symbol"))


@query("b15_clean_ticker", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE 'T' || o_custkey END AS ticker FROM orders")
def b15(v):
    return symbols(v).select("o_orderkey", C.clean_ticker("symbol").alias("ticker"))


@query(
    "b16_week_chunks",
    "SELECT issuer, CAST(a + (7*i)::INT AS DATE) AS chunk_start, CAST(least(a + (7*i + 6)::INT, z) AS DATE) AS chunk_end FROM (SELECT issuer, a, z, unnest(generate_series(0, (z - a)//7)) AS i FROM "
    "(SELECT issuer, min(filing_date) AS a, max(filing_date) AS z FROM filings_v GROUP BY 1))",
)
def b16(v):
    r = v.filings().groupBy("issuer").agg(F.min("filing_date").alias("a"), F.max("filing_date").alias("z"))
    return C.week_chunks(r, "a", "z").select("issuer", "chunk_start", "chunk_end")


@query(
    "b17_quarters_between",
    "SELECT q, count(*) AS n FROM (SELECT year(filing_date) || 'q' || quarter(filing_date) AS q FROM filings_v) WHERE q BETWEEN '1995q2' AND '1997q1' GROUP BY 1",
)
def b17(v):
    f = v.filings().withColumn("q", C.quarter_name("filing_date"))
    return C.quarters_between(f, "q", "1995q2", "1997q1").groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b18_exclude_affected",
    "SELECT signal_id FROM signals_v WHERE ts_utc >= (SELECT min(ts) + INTERVAL '5' DAY FROM events) AND NOT (ticker = 'error' AND n_symbols = 1)",
)
def b18(v):
    reason = F.when((F.col("ticker") == "error") & (F.col("n_symbols") == 1), "corporate_action")
    start = v.table("events").agg(after(F.min("ts"), 5 * 24 * 60)).scalar()
    return C.exclude_affected(v.signals().withColumn("suppress_reason", reason), "ts_utc", start).select("signal_id")


OLD_BARS = "SELECT ticker, ts, close + 1 AS close FROM bars_v WHERE ts < (SELECT min(ts) + INTERVAL '20' DAY FROM events)"
NEW_BARS = "SELECT ticker, ts, close FROM bars_v WHERE ts >= (SELECT min(ts) + INTERVAL '10' DAY FROM events)"


@query(
    "b19_merge_bars",
    "SELECT ticker, epoch_us(ts) AS ts_us, close FROM old_v UNION ALL SELECT ticker, epoch_us(ts), close FROM new_v n WHERE NOT EXISTS (SELECT 1 FROM old_v o WHERE o.ticker=n.ticker AND o.ts=n.ts)",
    old_v=OLD_BARS, new_v=NEW_BARS,
)
def b19(v):
    def day(n):
        return v.table("events").agg(after(F.min("ts"), n * 24 * 60)).scalar()

    b = v.bars().select("ticker", "ts", "close")
    old = b.filter(F.col("ts") < day(20)).withColumn("close", F.col("close") + 1)
    return C.merge_bars(old, b.filter(F.col("ts") >= day(10))).select("ticker", US("ts").alias("ts_us"), "close")


@query(
    "b20_stale_tickers",
    "SELECT ticker, epoch_us(max(ts)) AS last_us, max(ts) < (SELECT max(date_trunc('minute', ts)) FROM events) - INTERVAL '20' MINUTE AS stale FROM bars_v GROUP BY 1",
)
def b20(v):
    now = v.table("events").agg(F.max(F.date_trunc("minute", "ts"))).scalar()
    return C.stale_tickers(v.bars(), now).select("ticker", US("last_ts").alias("last_us"), "stale")


@query("b20_calendar_coverage", "SELECT max(d) AS last_day, max(d) < (SELECT CAST(max(ts) AS DATE) FROM events) + 14 AS stale FROM sessions_v")
def b20c(v):
    return C.calendar_stale(v.sessions(), v.table("events").agg(F.to_date(F.max("ts"))).scalar())


ACTIONS = "SELECT event_type AS ticker, strftime(ts, '%Y-%m-%d') AS ex_date, CASE WHEN value < 280 THEN 'forward_split' WHEN value < 330 THEN 'reverse_split' ELSE 'spin_off' END AS type FROM events WHERE value >= 230"
REGISTRY = "SELECT DISTINCT ticker, ex_date, type FROM act_v WHERE ticker IN ('click','signup') OR type = 'reverse_split'"


def actions(v):
    x = F.col("value")
    return v.table("events").filter(x >= 230).select(
        F.col("event_type").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("ex_date"),
        F.when(x < 280, "forward_split").when(x < 330, "reverse_split").otherwise("spin_off").alias("type"),
    )


def registry(v):
    return actions(v).filter("ticker IN ('click','signup') OR type = 'reverse_split'").distinct()


@query(
    "b21_reload_list",
    "SELECT a.ticker, a.ex_date, a.type FROM act_v a JOIN (SELECT ticker, min(ts) AS f FROM bars_v GROUP BY 1) b ON b.ticker=a.ticker WHERE a.type IN ('forward_split','reverse_split') AND b.f <= CAST(a.ex_date AS TIMESTAMP) "
    "AND NOT EXISTS (SELECT 1 FROM reg_v r WHERE r.ticker=a.ticker AND r.ex_date=a.ex_date AND r.type=a.type)",
    act_v=ACTIONS, reg_v=REGISTRY,
)
def b21(v):
    return C.reload_list(v.bars(), actions(v), registry(v))


@query("b22_registry_append", "SELECT DISTINCT ticker, ex_date, type FROM act_v", act_v=ACTIONS)
def b22(v):
    return C.extend_registry(registry(v), actions(v))


@query(
    "b23_distinct_items",
    "SELECT k, min(event_id) AS event_id FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN md5(concat_ws('|', epoch_us(date_trunc('hour', ts))//1000000, event_type)) ELSE CAST(user_id AS VARCHAR) END AS k FROM events) GROUP BY 1",
)
def b23(v):
    e = v.table("events").select(
        "event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("id"),
        F.unix_seconds(F.date_trunc("hour", "ts")).alias("datetime"), F.col("event_type").alias("headline"),
    )
    k = F.coalesce(F.col("id").cast("string"), F.md5(F.concat_ws("|", F.col("datetime").cast("string"), "headline")))
    return C.distinct_items(e, "id", "datetime", "headline", "event_id").select(k.alias("k"), "event_id")
