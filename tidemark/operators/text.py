"""Relevance, news type, sentiment and entity resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scan import first_per_key
from tidemark.operators.clean import clean_ticker, normalize_company

# Words that do not identify a company.
VARIANT_SUFFIXES = "inc incorporated corp corporation co company plc ltd limited sa ag nv holdings group".split()

# News types in order of precedence.
NEWS_TYPES = [
    ("earnings", r"\b(earnings|results|revenue|guidance|outlook|q[1-4]\b|fiscal|profit|beats? estimates|misses? estimates|eps\b|reports?\b)"),
    ("m&a", r"\b(acquir\w*|merger|merge[ds]?|takeover|buyout|to buy|acquisition|stake in|joint venture)"),
    ("regulatory", r"\b(sec |lawsuit|sues|fda|doj|antitrust|probe|investigation|fine[sd]?|settle(s|ment)?|recall|subpoena|regulator\w*|court )"),
    ("analyst", r"\b(upgrade[ds]?|downgrade[ds]?|price target|initiates? coverage|rating|overweight|underweight|buy rating|sell rating|neutral on|raises? pt)"),
    ("dividend_buyback", r"\b(dividend|buyback|repurchase|stock split)"),
    ("macro", r"\b(fed |fomc|inflation|cpi\b|ppi\b|jobs report|payrolls|rate cut|rate hike|interest rates?|treasury yields?|gdp\b|recession)"),
    ("product_business", r"\b(launch\w*|unveils?|partnership|contract|expansion|opens?|agreement|collaboration|new product|announces?)"),
]

# Default word lists of the sentiment scorer.
POSITIVE = [
    "beat", "beats", "best", "bullish", "gain", "gains", "growth", "high", "improve", "improved", "improves", "jump", "jumps", "optimistic", "outperform", "profit", "profitable",
    "profits", "raise", "raised", "raises", "rally", "rebound", "record", "rise", "rises", "soar", "soars", "strong", "stronger", "surge", "surges", "upbeat", "upgrade", "upgraded", "win", "wins",
]
NEGATIVE = [
    "bankruptcy", "bearish", "cut", "cuts", "decline", "declines", "default", "disappointing", "downgrade", "downgraded", "drop", "drops", "fall", "falls", "fraud", "investigation", "lawsuit",
    "layoffs", "loss", "losses", "low", "miss", "misses", "plunge", "plunges", "probe", "recall", "shortfall", "sink", "sinks", "slump", "tumble", "tumbles", "warning", "weak", "weaker",
]

PRIMARY, SECONDARY, PASSING = 1, 2, 3
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def name_variants(name: str | Column) -> Column:
    """Search names of a company: all words, the first two, the first if it has 6 or more letters."""
    norm = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9& ]+", " "))
    noise = F.array(*[F.lit(w) for w in [*VARIANT_SUFFIXES, "&", ""]])
    tokens = F.filter(F.split(norm, " +"), lambda w: ~F.array_contains(noise, w))
    first = F.try_element_at(tokens, F.lit(1))
    options = F.array(
        F.array_join(tokens, " "),
        F.when(F.size(tokens) >= 2, F.array_join(F.slice(tokens, 1, 2), " ")),
        F.when(F.length(first) >= 6, first),
    )
    return F.array_distinct(F.filter(options, lambda v: v.isNotNull() & (F.length(v) >= 3)))


def matchers(universe: DataFrame, case_sensitive_up_to: int = 0) -> DataFrame:
    """One whole-word pattern per ticker: the symbol or any variant of its `name`.

    Symbols of at most `case_sensitive_up_to` letters are matched in their own case only.
    """

    def quoted(c: Column) -> Column:
        return F.regexp_replace(c, r"([^\p{L}\p{N}_ ])", r"\\$1")

    symbol = F.when(F.length("ticker") <= case_sensitive_up_to, F.concat(F.lit("(?-i:"), quoted(F.col("ticker")), F.lit(")"))).otherwise(quoted(F.col("ticker")))
    words = F.concat(F.array(symbol), F.transform(name_variants("name"), quoted))
    pattern = F.concat(F.lit("(?iu)" + EDGE_L + "(?:"), F.array_join(words, "|"), F.lit(")" + EDGE_R))
    return universe.select("ticker", pattern.alias("pattern"))


def relevance_tier(news: DataFrame, patterns: DataFrame, headline: str = "headline", summary: str = "summary",
                   source: str = "source", strict_sources: Sequence[str] = ()) -> DataFrame:
    """Tier 1: named in the headline; 2: in headline or summary; 3: neither. Strict sources have no tier 2.

    regexp_instr keeps a pattern compiled while consecutive rows have the same one, which regexp_like does not. The
    patterns, one row per ticker of the universe, are sent to the texts: dealt by ticker, a busy one's texts were one task.
    """
    head = F.coalesce(F.col(headline), F.lit(""))
    both = F.concat_ws(" ", head, F.coalesce(F.col(summary), F.lit("")))
    joined = news.join(F.broadcast(patterns), "ticker", "left")
    tier = (
        F.when(F.coalesce(F.regexp_instr(head, F.col("pattern")) > 0, F.lit(False)), PRIMARY)
        .when(F.coalesce(F.regexp_instr(both, F.col("pattern")) > 0, F.lit(False)), SECONDARY)
        .otherwise(PASSING)
    )
    tagged = joined.withColumn("relevance_tier", tier).drop("pattern")
    if strict_sources:
        strict = F.col(source).isin(*strict_sources) & (F.col("relevance_tier") > PRIMARY)
        tagged = tagged.withColumn("relevance_tier", F.when(strict, PASSING).otherwise(F.col("relevance_tier")))
    return tagged


def keep_relevant(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("relevance_tier") < PASSING)


def tier_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("relevance_tier").agg(F.count(F.lit(1)).alias("n"))


def news_type(headline: str, summary: str, types: Sequence[tuple[str, str]] = NEWS_TYPES) -> Column:
    """First type whose pattern occurs in headline and summary, else 'other'."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(headline), F.lit("")), F.coalesce(F.col(summary), F.lit(""))))
    out = None
    for name, pattern in types:
        hit = text.rlike("(?U)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


# ---- sentiment ---------------------------------------------------------------------------------------
def normalized_sentiment(pos: Column, neg: Column, neu: Column) -> dict[str, Column]:
    """Shares of the three masses and (pos-neg)/sum; a zero sum divides by one."""
    total = pos + neg + neu
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return {"p_pos": pos / safe, "p_neg": neg / safe, "p_neu": neu / safe, "sent_score": (pos - neg) / safe}


def word_list_scorer(texts: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Default scorer: distinct word-list hits in the whole text, plus one neutral unit."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")

    def hits(vocabulary: Sequence[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))).cast("double")

    return texts.select("text_hash", hits(positive).alias("pos"), hits(negative).alias("neg"), F.lit(1.0).alias("neu"))


def pandas_scorer(fn: Callable[[pd.Series], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Wrap a model: `fn` maps a batch of texts to a frame with `pos`, `neg`, `neu`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scored = fn(b["text"]).reset_index(drop=True)
            yield pd.concat([b[["text_hash"]].reset_index(drop=True), scored[["pos", "neg", "neu"]]], axis=1)

    return lambda texts: texts.select("text_hash", "text").mapInPandas(run, "text_hash string, pos double, neg double, neu double")


SCORES = "text_hash string, p_pos double, p_neg double, p_neu double, sent_score double"


def score_with_cache(items: DataFrame, text: str, cache: DataFrame | None,
                     scorer: Callable[[DataFrame], DataFrame] = word_list_scorer) -> tuple[DataFrame, DataFrame]:
    """Score each distinct text once. Returns (items with scores, rows to append to the cache)."""
    hashed = items.withColumn("text_hash", F.md5(F.col(text)))
    unique = hashed.groupBy("text_hash").agg(F.first(text).alias("text"))
    missing = unique if cache is None else unique.join(cache, "text_hash", "left_anti")
    raw = scorer(missing)
    cols = normalized_sentiment(F.col("pos"), F.col("neg"), F.col("neu"))
    fresh = raw.select("text_hash", *[c.alias(n) for n, c in cols.items()])
    known = fresh if cache is None else cache.unionByName(fresh)
    return hashed.join(known, "text_hash", "left"), fresh


# ---- entities -------------------------------------------------------------------------------------------
def issuer_lookup(filings: DataFrame, order: str) -> DataFrame:
    """Normalised name -> issuer and cleaned ticker, one row per issuer and then per name."""
    one = first_per_key(filings, ["issuer"], [order])
    named = one.filter(F.col("symbol").isNotNull() & (F.col("symbol") != "NONE")).select(
        normalize_company("issuer_name").alias("name_norm"), "issuer", clean_ticker("symbol").alias("ticker"), order
    )
    return first_per_key(named.filter("ticker IS NOT NULL"), ["name_norm"], [order]).select("name_norm", "issuer", "ticker")


def one_mapping_per_identifier(mappings: DataFrame, key: str, sector: str, pos: str) -> DataFrame:
    """First listed mapping per identifier, equity rows before others."""
    return first_per_key(mappings, [key], [(F.col(sector) != "Equity").cast("int"), F.col(pos)])


def resolve_tickers(holdings: DataFrame, lookup: DataFrame, id_map: DataFrame) -> DataFrame:
    """By name first, then by identifier; `method` says which, null when unresolved."""
    named = holdings.withColumn("name_norm", normalize_company("name")).join(
        lookup.select("name_norm", F.col("ticker").alias("_nt"), "issuer"), "name_norm", "left"
    )
    both = named.join(id_map.select("cusip", F.col("ticker").alias("_it")), "cusip", "left")
    return both.withColumn("resolved_ticker", F.coalesce("_nt", "_it")).withColumn(
        "method", F.when(F.col("_nt").isNotNull(), "name").when(F.col("_it").isNotNull(), "identifier")
    ).drop("_nt", "_it")


def fill_issuer(universe: DataFrame, second: DataFrame) -> DataFrame:
    """Fill a missing issuer id by upper-cased ticker from a second table."""
    other = second.select(F.upper("ticker").alias("_u"), F.col("issuer").alias("_i2"))
    return universe.join(other, F.upper(universe["ticker"]) == F.col("_u"), "left").withColumn(
        "issuer_final", F.coalesce("issuer", "_i2")
    ).drop("_u", "_i2")


def latest_on_or_before(filings: DataFrame, key: str, date: str, as_of: Column) -> DataFrame:
    return filings.filter(F.col(date) <= as_of).groupBy(key).agg(
        F.max(F.struct(F.col(date), F.col("accession"))).alias("m")
    ).select(key, F.col(f"m.{date}").alias(date), F.col("m.accession").alias("accession"))


def liquidity_flags(holdings: DataFrame, adv: DataFrame, order: str, min_price: float = 1.0, min_adv: float = 1_000_000) -> DataFrame:
    """Resolved holdings with the step each one reaches: 0 price, 1 dollar volume, 2 share class, 3 kept."""
    df = holdings.filter("resolved_ticker IS NOT NULL").withColumn("ticker_primary", F.replace(F.col("resolved_ticker"), F.lit("/"), F.lit(".")))
    j = df.join(adv.select(F.col("ticker").alias("ticker_primary"), "adv"), "ticker_primary", "left")
    ok_price = F.coalesce(F.col("price") >= min_price, F.lit(False))
    ok_adv = ok_price & F.coalesce(F.col("adv") >= min_adv, F.lit(False))
    passed = j.withColumn("step", F.when(~ok_price, 0).when(~ok_adv, 1).otherwise(2))
    kept = first_per_key(passed.filter("step = 2"), ["ticker_primary"], [order]).select(order).withColumn("_keep", F.lit(True))
    return passed.join(kept, order, "left").withColumn("step", F.when(F.col("_keep"), 3).otherwise(F.col("step"))).drop("_keep")


def liquidity_funnel(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("n_resolved"), F.count_if(F.col("step") >= 1).alias("n_price"),
        F.count_if(F.col("step") >= 2).alias("n_adv"), F.count_if(F.col("step") >= 3).alias("n_share_class"),
    )
