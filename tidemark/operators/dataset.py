"""The historical data set as one flow: raw items and bars in, labelled events with every feature out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import clean, frame, text
from tidemark.operators.align import compute_events, regular_bars
from tidemark.operators.features import leakage_checks


@dataclass
class Dataset:
    """What a build gives; all lazy but for what `keep` wrote."""

    events: DataFrame  # one row per event: item, entry, exit, forward return, features
    tickers: DataFrame  # universe with regular bars and whether they are enough
    funnel: DataFrame  # items left after each step
    checks: DataFrame  # ordering violations, overnight events, delay quantiles


def bar_coverage(universe: DataFrame, regular: DataFrame, least: int = P.MIN_REGULAR_BARS) -> DataFrame:
    """Regular bars per universe ticker, 0 included, and whether there are at least `least`."""
    counts = regular.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return universe.select("ticker").distinct().join(counts, "ticker", "left").select("ticker", n.alias("n_bars"), (n >= least).alias("enough"))


def _steps(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (position, step, n), counted in one job."""
    out = None
    for i, (name, df) in enumerate(steps):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("position"), F.lit(name).alias("step"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def build_dataset(
    news: DataFrame, bars: DataFrame, sessions: DataFrame, bench: DataFrame, universe: DataFrame, sectors: Sequence[str], *,
    item_id: str = "news_id", t: str = "published_utc", types: Sequence[tuple[str, str]] = text.NEWS_TYPES, strict_sources: Sequence[str] = (),
    scorer: Callable[[DataFrame], DataFrame] = text.word_list_scorer, cache: DataFrame | None = None,
    horizon: int = P.HORIZON_BARS, max_delay_min: float = P.ENTRY_MAX_DELAY_MIN, least_bars: int = P.MIN_REGULAR_BARS, min_anchors: int = P.SIGMA_MIN_ANCHORS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Dataset:
    """Deduplicate, keep relevant items, skip tickers with few regular bars, align, add features, check.

    `news` has `item_id` (unique integer), ticker, headline, summary, source and `t`; `bars` one row per ticker and minute;
    `bench` (d, c); `universe` ticker, name and sector. `keep` cuts the lineage of what several steps read (a checkpoint or a
    written table). Only regular bars count, for entries and for features. Recency looks at all relevant items, also at those
    that never become events. Items with null ticker, time or headline drop before all else; events without enough hourly bars
    drop last, and the funnel says how many. Empty inputs give empty events and a funnel of zeros.
    """
    whole = clean.drop_incomplete(news, "ticker", t, "headline")
    unique = clean.dedupe_news(whole, t, item_id)
    tagged = text.relevance_tier(unique, text.matchers(universe), strict_sources=strict_sources)
    # Dropped items are only counted from here on; their texts are not written.
    tagged = keep(tagged.withColumn("summary", F.when(F.col("relevance_tier") < text.PASSING, F.col("summary"))))
    relevant = text.keep_relevant(tagged)

    regular = regular_bars(bars, sessions)
    tickers = keep(bar_coverage(universe, regular, least_bars))
    usable = keep(regular.join(tickers.filter("enough"), "ticker", "left_semi").drop("sess_start", "sess_end"))

    aligned = clean.with_event_id(compute_events(relevant, usable, sessions, t, horizon, max_delay_min), t, item_id)
    typed = aligned.withColumn("news_type", text.news_type("headline", "summary", types))
    scored = keep(text.score_with_cache(typed, "headline", cache, scorer)[0].drop("text_hash"))

    expected = frame.expected_columns(sectors, [*[name for name, _ in types], "other"])
    seen = relevant.select("ticker", F.col(t).alias("nt"))
    features = frame.feature_frame(scored, usable, sessions, bench, universe, seen, expected, key="event_id", t=t, min_anchors=min_anchors, keep=keep)
    own = [item_id, "relevance_tier", "news_type", "entry_ts", "entry_price", "exit_ts", "exit_price", "delay_sec", "fwd_ret"]
    events = keep(features.join(scored.select("event_id", *own), "event_id"))

    funnel = _steps([("raw", news), ("complete", whole), ("deduplicated", tagged), *[(f"tier {i}", tagged.filter(F.col("relevance_tier") == i)) for i in (1, 2, 3)], ("relevant", relevant), ("aligned", scored), ("featured", events)])
    return Dataset(events, tickers, funnel, leakage_checks(events, t, "entry_ts", "exit_ts", "delay_sec"))
