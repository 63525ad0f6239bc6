"""The whole feature frame of news items, one row per item: the batch build and what it shares with the live one.

Both builds make the same parts (one row per item each) and put them together with `assemble`, so live features differ
from batch features in where the bars come from and in nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import features as E
from tidemark.operators.text import NEWS_TYPES
from tidemark.session import settle

BENCH = ["dist_sma_fast", "dist_sma_slow", "above_slow"]
REGIME = ["rv_short", "vol_ratio", "mom"]
SENTIMENT = ["p_pos", "p_neg", "p_neu", "sent_score"]
NUMERIC = [*E.INDICATORS, "dist_from_vwap", *BENCH, *REGIME, "sector_mean_mom", "sector_rel_mom", *SENTIMENT, "hours_since_prev", "items_prior", "et_hour", "sigma"]
NEWS_TYPE_NAMES = [*[name for name, _ in NEWS_TYPES], "other"]


def expected_columns(sectors: Sequence[str], types: Sequence[str] = NEWS_TYPE_NAMES) -> list[str]:
    """Feature columns in their fixed order: numbers, then one flag per sector and news type."""
    return [*NUMERIC, *[f"sect_{s}" for s in sectors], *[f"nt_{t}" for t in types]]


def assemble(items: DataFrame, key: str, t: str, parts: Sequence[DataFrame], universe: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Items with the expected feature columns, from parts keyed by `key`; items that a part lacks drop (warm-up).

    `items` has ticker, `t`, news_type and the sentiment columns; parts have the other features, own momentum as `mom`
    and that of the sector's tickers as `peer_mom`. Without a peer mean the sector is the item's own ticker.
    """
    rows = items.select(key, "ticker", t, "news_type", *SENTIMENT).join(universe.select("ticker", "sector"), "ticker", "left")
    for part in parts:
        rows = rows.join(part, key)
    own, peer = F.col("mom"), F.col("peer_mom")
    rows = rows.withColumn("sector_mean_mom", F.when(own.isNotNull(), F.coalesce(peer, own)))
    rows = rows.withColumn("sector_rel_mom", own - F.col("sector_mean_mom")).withColumn("et_hour", E.et_hour(t))
    sectors = [c[5:] for c in expected if c.startswith("sect_")]
    types = [c[3:] for c in expected if c.startswith("nt_")]
    flagged = E.one_hot(E.one_hot(rows, "sector", sectors, "sect"), "news_type", types, "nt")
    return _aligned(flagged, [key, "ticker", t], expected)


def _aligned(df: DataFrame, keep: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """`features.align_columns` beside the item's own columns."""
    flags = ("sect_", "nt_")
    columns = [(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in expected]
    return df.select(*keep, *columns).fillna(0.0, [c for c in expected if c.startswith(flags)])


def benchmark_part(points: DataFrame, key: str, t: str, bench: DataFrame) -> DataFrame:
    """The benchmark's regime on the last day before the item; one row per day enters, whatever the items."""
    j = E.prior_day(points.select(key, t), E.benchmark_regime(bench), t, BENCH, by=(), out="_b")
    return j.select(key, *[F.col(f"_b.{c}").alias(c) for c in BENCH])


def feature_frame(
    items: DataFrame, bars: DataFrame, sessions: DataFrame, bench: DataFrame, universe: DataFrame, seen: DataFrame, expected: Sequence[str],
    key: str = "news_hash", t: str = "published_utc", nt: str = "nt", min_bars: int = P.MIN_HOURLY_BARS, min_anchors: int = P.SIGMA_MIN_ANCHORS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The batch build: every feature at each item's time, from whole bar tables.

    `seen` has the ticker and first-seen time `nt` of all items. Items without `min_bars` completed hours drop.
    `keep` cuts the lineage of each part, a few columns per item, and of the daily and hourly rows, so that no plan holds all.
    """
    points = items.select(key, "ticker", t)
    daily = keep(E.daily_closes(bars))
    hourly = keep(E.hourly_indicators(settle(E.hourly_bars(bars))))
    tech = E.session_vwap(E.last_completed_hour(points, hourly, t, E.INDICATORS, min_bars), bars, sessions, t)
    tech = tech.filter("hb IS NOT NULL").select(key, *[F.col(f"hb.{c}").alias(c) for c in E.INDICATORS], "dist_from_vwap")
    regime = E.prior_valid_day(points, daily, E.ticker_regime(daily), t, REGIME).select(key, *[F.col(f"pd.{c}").alias(c) for c in REGIME])
    dated = points.join(universe.select("ticker", "sector"), "ticker", "left").withColumn("date", F.to_date(t))
    peers = E.peer_momentum(universe, daily, dated.filter("sector IS NOT NULL"))
    peer = dated.join(peers, ["sector", "date"], "left").select(key, "peer_mom")
    flow = E.news_recency(points, seen, t, nt, inclusive_start=True).select(key, "hours_since_prev", "items_prior")
    sigma = E.trailing_sigma(points, E.sigma_anchors(bars), t, min_anchors).select(key, "sigma")
    parts = [tech, benchmark_part(points, key, t, bench), regime, peer, flow, sigma]
    return assemble(items, key, t, [keep(p) for p in parts], universe, expected)
