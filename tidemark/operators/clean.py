"""Cleaning, identity and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.scan import first_per_key, micros, position, time_block
from tidemark.operators.align import with_session

# Company-name words and state marks that carry no identity.
NAME_SUFFIXES = "INC INCORPORATED CORP CORPORATION CO COMPANY LTD LIMITED LLC LP PLC THE".split()
NAME_STATE_MARKS = "DE MD NEW VA".split()
EXCHANGE_PREFIXES = ["NYSE", "NASDAQ", "NYSEAMERICAN", "NYSE AMERICAN", "OTC", "OTCMKTS"]


def normalize_headline(h: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", " "))


def drop_incomplete(df: DataFrame, *required: str) -> DataFrame:
    return df.dropna(subset=list(required))


def near_duplicates(news: DataFrame, t: str, item_id: str, headline: str = "headline",
                    prefix: int = P.NEAR_DUP_PREFIX, minutes: int = P.NEAR_DUP_MINUTES) -> DataFrame:
    """Ids whose previous raw item of the ticker is at most `minutes` older and shares the key prefix.

    Only an item at most `minutes` older can match, so each item is looked up inside its own
    `minutes`-wide time block and the block before it; no task sees a whole ticker.
    """
    width = minutes * 60_000_000
    rows = news.select(
        "ticker", F.col(t).alias("t"), F.col(item_id).alias("id"),
        F.substring(normalize_headline(headline), 1, prefix).alias("k"), time_block(t, width).alias("home"),
    ).withColumn("b", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    w = Window.partitionBy("ticker", "b").orderBy("t", "id")
    seen = rows.withColumn("pk", F.lag("k").over(w)).withColumn("pt", F.lag("t").over(w))
    hit = (F.col("b") == F.col("home")) & (F.col("pk") == F.col("k")) & (micros("t") - micros("pt") <= width)
    return seen.filter(hit).select(F.col("id").alias(item_id))


def first_copies(news: DataFrame, t: str, item_id: str, headline: str = "headline") -> DataFrame:
    """Ids of the first item ever per (ticker, normalised headline)."""
    keyed = news.select("ticker", F.md5(normalize_headline(headline)).alias("k"), t, item_id)
    return first_per_key(keyed, ["ticker", "k"], [t, item_id]).select(item_id)


def dedupe_news(news: DataFrame, t: str, item_id: str) -> DataFrame:
    """Drop near and exact duplicates; both are judged on the same raw items."""
    return news.join(near_duplicates(news, t, item_id), item_id, "left_anti").join(
        first_copies(news, t, item_id), item_id, "left_semi"
    )


def dedupe_bars(bars: DataFrame, tie: str) -> DataFrame:
    return first_per_key(bars, ["ticker", "ts"], [tie])


def drop_zero_volume(bars: DataFrame, volume: str = "volume") -> DataFrame:
    return bars.filter(F.col(volume) > 0)


def regular_minutes(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_session(bars, "ts", sessions, "left_semi")


def news_hash(source: Column, ticker: Column, headline: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", source, ticker, headline, epoch.cast("string")))


def story_group(ticker: Column, t: str, minutes: int = P.STORY_MINUTES) -> Column:
    """12-character id of the ticker's `minutes`-wide time bucket."""
    start = F.timestamp_micros(time_block(t, minutes * 60_000_000) * F.lit(minutes * 60_000_000))
    iso = F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.substring(F.md5(F.concat_ws("|", ticker, iso)), 1, 12)


def with_event_id(df: DataFrame, t: str, tie: str) -> DataFrame:
    """ticker_epoch_number, numbered from 0 inside (ticker, epoch)."""
    rows = df.withColumn("_ep", F.unix_seconds(t))
    numbered = position(rows, ["ticker", "_ep"], [tie], F.floor(F.col(tie) / 4096).cast("long"), "_k")
    return numbered.withColumn("event_id", F.concat_ws("_", "ticker", "_ep", F.col("_k") - 1)).drop("_ep", "_k")


def pair_kth(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
             columns: Sequence[str], chunk: int = 4096) -> DataFrame:
    """Pair the k-th duplicate of a key with the k-th duplicate in the other log; null keys match as ''.

    `left_id` and `right_id` are increasing integers; their `chunk`-wide ranges cut hot keys.
    """
    keys = list(keys)

    def numbered(df: DataFrame, id_col: str, extra: Sequence[str]) -> DataFrame:
        filled = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], id_col, *extra)
        return position(filled, keys, [id_col], F.floor(F.col(id_col) / chunk).cast("long"), "_k")

    a = numbered(left, left_id, [])
    b = numbered(right, right_id, list(columns)).drop(right_id) if right_id not in columns else numbered(right, right_id, [c for c in columns if c != right_id])
    return a.join(b, [*keys, "_k"], "left")


def redact(text: str | Column, secrets: dict[str, str]) -> Column:
    """Mask each non-empty secret value by its name.

    The values come from a one-row frame through scalar subqueries, so that plans, which are logged, don't show them.
    """
    out = F.col(text) if isinstance(text, str) else text
    held = {name: value for name, value in secrets.items() if value}
    if not held:
        return out
    one = SparkSession.active().createDataFrame([tuple(held.values())], ", ".join(f"`{name}` string" for name in held))
    for name in held:
        out = F.replace(out, one.select(f"`{name}`").scalar(), F.lit(f"***REDACTED_{name}***"))
    return out


def normalize_company(name: str | Column) -> Column:
    noise = r"\b(?:" + "|".join(NAME_SUFFIXES) + r")\b|/(?:" + "|".join(NAME_STATE_MARKS) + ")/"
    plain = F.regexp_replace(F.regexp_replace(F.upper(name), "[.,'&]", " "), noise, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^A-Z0-9 ]", " "), " +", " "))


def clean_ticker(symbol: str | Column) -> Column:
    """Primary symbol: exchange prefix off, first of a comma list; null when ambiguous ('/')."""
    s = F.trim(symbol)
    pattern = "(?i)^(?:" + "|".join(EXCHANGE_PREFIXES) + r")\s*[:/]\s*(.+)$"
    bare = F.when(s.rlike(pattern), F.trim(F.regexp_extract(s, pattern, 1))).otherwise(s)
    first = F.trim(F.element_at(F.split(bare, ","), 1))
    return F.when(~first.contains("/"), first)


def week_chunks(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Seven-day chunks [start, start+6] of each date range, the last one clipped."""
    s = F.explode(F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 7 DAYS")))
    return ranges.withColumn("chunk_start", s).withColumn("chunk_end", F.least(F.date_add("chunk_start", 6), F.col(end)))


def quarter_name(d: str | Column) -> Column:
    return F.concat(F.year(d), F.lit("q"), F.quarter(d))


def quarters_between(df: DataFrame, quarter: str, first: str, last: str) -> DataFrame:
    return df.filter(F.col(quarter).between(first, last))


def exclude_affected(signals: DataFrame, t: str, affected_until: Column, reasons: Sequence[str] = ("corporate_action",)) -> DataFrame:
    """Drop the affected time window and the listed suppression reasons."""
    return signals.filter((F.col(t) >= affected_until) & ~F.coalesce(F.col("suppress_reason"), F.lit("")).isin(*reasons))


def merge_bars(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh bars added to cached ones; a cached bar wins on the same (ticker, ts)."""
    return existing.unionByName(fresh.join(existing, ["ticker", "ts"], "left_anti"))


def stale_tickers(bars: DataFrame, now: Column, minutes: int = 20) -> DataFrame:
    last = bars.groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    return last.withColumn("stale", micros("last_ts") < F.unix_micros(now) - F.lit(minutes).cast("long") * 60_000_000)


def calendar_stale(calendar: DataFrame, today: Column, buffer_days: int = 14) -> DataFrame:
    """One row: does the calendar end before `buffer_days` from today?"""
    return calendar.agg(F.max("d").alias("last_day")).withColumn("stale", F.coalesce(F.col("last_day") < F.date_add(today, buffer_days), F.lit(True)))


def unhandled(actions: DataFrame, registry: DataFrame) -> DataFrame:
    """Actions whose (ticker, ex_date, type) is not in the registry."""
    return actions.join(registry, ["ticker", "ex_date", "type"], "left_anti")


def reload_list(bars: DataFrame, actions: DataFrame, registry: DataFrame) -> DataFrame:
    """Tickers whose bar history reaches back over a split that has not been handled."""
    splits = unhandled(actions.filter(F.col("type").isin("forward_split", "reverse_split")), registry)
    first = bars.groupBy("ticker").agg(F.min("ts").alias("first_ts"))
    return splits.join(first, "ticker").filter(F.col("first_ts") <= F.to_timestamp("ex_date")).select("ticker", "ex_date", "type")


def extend_registry(registry: DataFrame, actions: DataFrame) -> DataFrame:
    cols = ["ticker", "ex_date", "type"]
    return registry.select(*cols).unionByName(unhandled(actions.select(*cols).distinct(), registry))


def distinct_items(items: DataFrame, item_id: str, t: str, headline: str, arrival: str) -> DataFrame:
    """One row per id over overlapping chunks, first arrival kept; items without an id by (time, headline)."""
    key = F.coalesce(F.col(item_id).cast("string"), F.md5(F.concat_ws("|", F.col(t).cast("string"), F.col(headline))))
    return first_per_key(items.withColumn("_key", key), ["_key"], [arrival]).drop("_key")


