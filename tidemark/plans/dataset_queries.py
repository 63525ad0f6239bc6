"""Registered queries: the historical data set as one flow."""

from pyspark.sql import functions as F

from tidemark.operators import text as X
from tidemark.operators.dataset import bar_coverage, build_dataset
from tidemark.plans.alignment_queries import RB, _ev_sql, regular
from tidemark.plans.cleaning_queries import FIRST, N_HEAD, NEAR
from tidemark.plans.features_queries import ANCH, H, HE, HOURLY
from tidemark.plans.registry import query
from tidemark.plans.text_queries import PROSE_TYPES, PROSE_WORDS, TIER, _hits, _type_sql, profiled


def build(v):
    return build_dataset(
        v.news(), v.bars().withColumn("volume", F.col("volume").cast("long")), v.sessions(), v.bench(), profiled(v), ["A", "B"], types=PROSE_TYPES,
        scorer=lambda t: X.word_list_scorer(t, *PROSE_WORDS), min_anchors=10, keep=v.keep,
    )


DS = {
    "rb_v": RB,
    "raw_v": "SELECT * FROM news_v WHERE ticker IS NOT NULL AND published_utc IS NOT NULL AND headline IS NOT NULL",
    "dd_v": f"SELECT * FROM raw_v WHERE news_id NOT IN ({NEAR.format(n=N_HEAD, t='raw_v')}) AND news_id IN ({FIRST.format(n=N_HEAD, t='raw_v')})",
    "tier_v": TIER.replace("news_v", "dd_v"),
    "rel_v": "SELECT * FROM tier_v WHERE tier < 3",
    "use_v": "SELECT ticker FROM rb_v GROUP BY 1 HAVING count(*) >= 500",
    "al_v": _ev_sql(120).replace("news_v", "rel_v") + " AND n.ticker IN (SELECT ticker FROM use_v)",
    "id_v": "SELECT *, concat_ws('_', ticker, epoch_us(published_utc)//1000000, row_number() OVER (PARTITION BY ticker, epoch_us(published_utc)//1000000 ORDER BY news_id) - 1) AS event_id FROM al_v",
    **{k: q for k, q in H.items() if k != "rb_v"},
    "hour_v": HOURLY.replace("bars_v", "sess_bars_v"),
    "he_v": HE,
    "anch_v": ANCH,
    "sd_v": "SELECT ticker, end_ts, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS k FROM anch_v WINDOW w AS (PARTITION BY ticker ORDER BY end_ts)",
    "ty_v": _type_sql(PROSE_TYPES),
    "fl_v": "SELECT i.event_id, count(r.news_id) FILTER (r.published_utc >= i.published_utc - INTERVAL '24' HOUR) AS items_prior, max(r.published_utc) AS prev FROM id_v i LEFT JOIN rel_v r ON r.ticker=i.ticker AND r.published_utc < i.published_utc GROUP BY 1",
    "ds_v": "SELECT i.*, h.rsi, h.atr_pct, CASE WHEN a.k >= 10 THEN a.sd END AS sigma FROM id_v i ASOF JOIN he_v h ON h.ticker=i.ticker AND h.hour_end < i.published_utc ASOF LEFT JOIN sd_v a ON a.ticker=i.ticker AND a.end_ts < i.published_utc",
    "se_v": f"SELECT event_id, (pos-neg)/(pos+neg+1.0) AS sent_score FROM (SELECT event_id, {_hits(PROSE_WORDS[0])}::DOUBLE AS pos, {_hits(PROSE_WORDS[1])}::DOUBLE AS neg FROM (SELECT event_id, headline AS text FROM id_v))",
}


@query(
    "flow_dataset_events",
    "SELECT d.event_id, d.news_id, d.tier AS relevance_tier, t.news_type, epoch_us(d.entry_ts) AS entry_us, epoch_us(d.exit_ts) AS exit_us, d.delay_sec, round(d.fwd_ret,8) AS fwd_ret, round(d.rsi,6) AS rsi, round(d.atr_pct,7) AS atr_pct, round(d.sigma,7) AS sigma, round(s.sent_score,9) AS sent_score, "
    "f.items_prior::DOUBLE AS items_prior, round((epoch_us(d.published_utc)-epoch_us(f.prev))/3.6e9,7) AS hours_since_prev, (d.ticker IN ('click','view'))::INT::DOUBLE AS sect_a FROM ds_v d JOIN ty_v t ON t.news_id=d.news_id JOIN fl_v f ON f.event_id=d.event_id JOIN se_v s ON s.event_id=d.event_id",
    **DS,
)
def events(v):
    """Labelled events with features, from raw items and bars in one flow."""
    e = build(v).events
    cols = [F.round(c, n).alias(c) for c, n in (("fwd_ret", 8), ("rsi", 6), ("atr_pct", 7), ("sigma", 7), ("sent_score", 9), ("hours_since_prev", 7))]
    return e.select("event_id", "news_id", "relevance_tier", "news_type", F.unix_micros("entry_ts").alias("entry_us"), F.unix_micros("exit_ts").alias("exit_us"), "delay_sec", *cols, "items_prior", F.col("sect_A").alias("sect_a"))


@query(
    "flow_dataset_funnel",
    "SELECT 'raw' AS step, count(*) AS n FROM news_v UNION ALL SELECT 'complete', count(*) FROM raw_v UNION ALL SELECT 'deduplicated', count(*) FROM dd_v UNION ALL SELECT 'tier ' || i, count(*) FILTER (tier = i) FROM tier_v, (VALUES (1),(2),(3)) x(i) GROUP BY i UNION ALL "
    "SELECT 'relevant', count(*) FROM rel_v UNION ALL SELECT 'aligned', count(*) FROM id_v UNION ALL SELECT 'featured', count(*) FROM ds_v",
    **DS,
)
def funnel(v):
    """Items left after each step of the build."""
    return build(v).funnel.select("step", "n")


@query("flow_bar_coverage", "SELECT u.ticker, count(b.ts) AS n_bars, count(b.ts) >= 500 AS enough FROM universe_v u LEFT JOIN rb_v b ON b.ticker=u.ticker GROUP BY 1", rb_v=RB)
def coverage(v):
    """Regular bars per ticker; those with fewer than 500 are skipped."""
    return bar_coverage(v.universe(), regular(v))
