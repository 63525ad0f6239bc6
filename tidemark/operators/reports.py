"""Report tables and data-quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.hashing import hash32
from tidemark.functions.scan import DAY, HOUR, asof, exact_quantiles, merge_intervals, top_per_key
from tidemark.operators.stats import wilson

ET = "America/New_York"


def n() -> Column:
    return F.count(F.lit(1)).alias("n")


def et_day(c: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(c), ET))


def counts_by_sets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each column on its own, in one pass of grouping sets."""
    cols = list(columns)
    g = df.select(*[F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in cols]).groupingSets([[c] for c in cols], *cols)
    out = g.agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    dim = val = None
    for i, c in enumerate(cols):
        own = F.col(f"_g{i}") == 0
        dim = F.when(own, c) if dim is None else dim.when(own, c)
        val = F.when(own, F.col(c)) if val is None else val.when(own, F.col(c))
    return out.select(dim.alias("dimension"), val.alias("value"), "n")


def ticker_class_pivot(signals: DataFrame, classes: Sequence[str] = P.CLASSES_4) -> DataFrame:
    p = signals.groupBy("ticker").pivot("class_name", list(classes)).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in classes[1:]), F.col(f"`{classes[0]}`"))
    return p.withColumn("total", total).orderBy(F.col("total").desc(), "ticker")


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each ordered filter, all steps in one pass."""
    kept, aggs = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for i, (_, cond) in enumerate(steps, 1):
        kept = kept & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(kept).alias(f"s{i}"))
    names = ["all rows", *[s for s, _ in steps]]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"s{i}").alias("n")) for i, name in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))


def sample_gates(signals: DataFrame, t: str, min_days: int = P.MIN_ACTIVE_DAYS, min_fired: int = P.MIN_FIRED) -> DataFrame:
    fired = (F.col("status") == "fired") & F.col("class_name").isin(*P.LONG_CLASSES)
    g = signals.agg(F.countDistinct(F.when(fired, et_day(t))).alias("n_fired_days"), F.count_if(fired).alias("n_fired"), F.countDistinct(et_day(t)).alias("n_days"))
    ok = (F.col("n_fired_days") >= min_days) & (F.col("n_fired") >= min_fired)
    return g.withColumn("verdict", F.when(ok, "minimum sample reached").otherwise("too small to conclude"))


def with_report_groups(signals: DataFrame) -> DataFrame:
    """Each signal once per overlapping report group."""
    fired = (F.col("status") == "fired") & F.col("class_name").isin(*P.LONG_CLASSES)
    groups = F.filter(F.array(F.lit("all signals"), F.col("class_name"), F.when(fired, "fired Buy/Strong Buy")), lambda g: g.isNotNull())
    return signals.withColumn("grp", F.explode(groups))


def raw_and_adjusted(trades: DataFrame, raw: str, adjusted: str) -> DataFrame:
    """Each trade once per report group and measure, the value in `x`; rows without a value drop."""
    both = F.inline(F.array(F.struct(F.lit("raw").alias("measure"), F.col(raw).alias("x")), F.struct(F.lit("adjusted").alias("measure"), F.col(adjusted).alias("x"))))
    return with_report_groups(trades).select("*", both).filter(F.col("x").isNotNull())


def regime_buckets(df: DataFrame, above: str, vol_ratio: str, mom: str, tod: str) -> DataFrame:
    """Each row once per breakdown dimension, missing values in their own bucket."""
    def three(c, yes, label):
        return F.when(F.col(c).isNull(), f"{label} missing").when(yes, f"{label} high").otherwise(f"{label} low")

    dims = F.array(
        F.struct(F.lit("benchmark").alias("dimension"), three(above, F.col(above) == 1, "benchmark").alias("bucket")),
        F.struct(F.lit("vol").alias("dimension"), three(vol_ratio, F.col(vol_ratio) > 1, "vol").alias("bucket")),
        F.struct(F.lit("mom").alias("dimension"), three(mom, F.col(mom) > 0, "mom").alias("bucket")),
        F.struct(F.lit("tod").alias("dimension"), F.coalesce(F.col(tod), F.lit("tod missing")).alias("bucket")),
    )
    return df.select("*", F.inline(dims))


def negative_share(df: DataFrame, value: str, cls: str = "Sell") -> DataFrame:
    d = df.filter((F.col("class_name") == cls) & F.col(value).isNotNull())
    return d.agg(n(), F.avg((F.col(value) < 0).cast("double")).alias("negative_share"))


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy("ticker").agg(n(), F.min("ts_utc").alias("first_seen"), F.max("ts_utc").alias("last_seen"))


def outcome_summary(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per class: win share with its Wilson interval, mean net return and stop rate. Silent signals count."""
    j = outcomes.join(signals.select("signal_id", "class_name"), "signal_id").groupBy("class_name").agg(
        F.count("ret_net").alias("n"), F.count_if(F.col("ret_net") > 0).alias("wins"), F.avg("ret_net").alias("mean_net"), F.avg(F.col("stopped").cast("double")).alias("stop_rate")
    )
    lo, hi = wilson(F.col("wins"), F.col("n"))
    return j.select("class_name", "n", (F.try_divide(F.col("wins"), F.col("n"))).alias("win"), lo.alias("win_lo"), hi.alias("win_hi"), "mean_net", "stop_rate")


def valid_days(cycles: DataFrame, fired: DataFrame, failures: DataFrame, min_uptime: float = 0.95, max_proxy: float = 0.2, max_error: float = 0.05, max_missing: float = 0.1) -> DataFrame:
    """Per day: coverage, proxy share, cycle-error rate and worst ticker's missed cycles, with the verdict.

    `cycles` has day, ok, up_min, session_min (per cycle); `fired` day, entry_source; `failures` day, ticker.
    """
    c = cycles.groupBy("day").agg(F.count(F.lit(1)).alias("n_cycles"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), (F.sum("up_min") / F.sum("session_min")).alias("uptime"))
    f = fired.groupBy("day").agg(F.avg((F.col("entry_source") != "live_trade").cast("double")).alias("proxy_share"))
    worst = failures.groupBy("day", "ticker").agg(F.count(F.lit(1)).alias("k")).groupBy("day").agg(F.max("k").alias("worst_missed"))
    j = c.join(f, "day", "left").join(worst, "day", "left")
    j = j.withColumn("worst_missing_share", F.coalesce("worst_missed", F.lit(0)) / F.col("n_cycles"))
    ok = (F.col("uptime") >= min_uptime) & (F.coalesce("proxy_share", F.lit(0.0)) <= max_proxy) & (F.col("error_rate") < max_error) & (F.col("worst_missing_share") <= max_missing)
    return j.select("day", "n_cycles", "error_rate", "uptime", "proxy_share", "worst_missing_share", ok.alias("valid"))


def decision_rule(stats: DataFrame, max_drift: Column, stop_share: Column, proxy_share: Column) -> DataFrame:
    """Verdict row of the five conditions on one row with lo, p_le_0 and t."""
    c = {
        "ci_above_zero": F.col("lo") > 0, "p_small": F.col("p_le_0") < 0.05, "t_large": F.col("t") >= 2.0, "calibrated": max_drift <= 0.10,
        "sane": stop_share.between(0.10, 0.60) & (proxy_share < 0.20),
    }
    out = stats.select(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in c.items()])
    every = F.lit(True)
    for k in c:
        every = every & F.col(k)
    return out.withColumn("verdict", F.when(every, "promote").otherwise("keep watching"))


def day_blocks(outcomes: DataFrame, day: str, value: str, size: int = 20) -> DataFrame:
    """Win share per class and block of `size` active days, and whether it overlaps the pooled interval."""
    days = outcomes.select("class_name", day).distinct()
    ranked = days.withColumn("block", F.floor((F.dense_rank().over(Window.partitionBy("class_name").orderBy(day)) - 1) / size).cast("int"))
    win = F.count_if(F.col(value) > 0)
    b = outcomes.join(ranked, ["class_name", day]).groupBy("class_name", "block").agg(n(), win.alias("k"))
    p = outcomes.groupBy("class_name").agg(F.count(F.lit(1)).alias("pn"), win.alias("pk"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    plo, phi = wilson(F.col("pk"), F.col("pn"))
    return b.join(p, "class_name").select("class_name", "block", "n", (F.try_divide(F.col("k"), F.col("n"))).alias("win"), lo.alias("lo"), hi.alias("hi"), ((lo <= phi) & (hi >= plo)).alias("overlaps_pooled"))


def lag_summary(df: DataFrame, lag: str, by: Sequence[str] = ()) -> DataFrame:
    """min/median/mean/p90/p95/max of a lag, per group."""
    by = list(by)
    base = df.groupBy(*by).agg(n(), F.min(lag).alias("min"), F.avg(lag).alias("mean"), F.max(lag).alias("max"))
    q = exact_quantiles(df, by, lag, {"median": 0.5, "p90": 0.9, "p95": 0.95})
    if by:
        return base.join(q, by)
    return base.withColumn("_q", q.select(F.struct("*")).scalar()).select(*base.columns, "_q.*")


def lag_cdf(df: DataFrame, lag: str, cuts: Sequence[int] = (15, 30, 60, 120)) -> DataFrame:
    one = df.agg(*[F.avg((F.col(lag) <= c).cast("double")).alias(str(c)) for c in cuts])
    return one.unpivot([], [str(c) for c in cuts], "cut", "share").withColumn("cut", F.col("cut").cast("int"))


def feed_coverage(universe: DataFrame, items: DataFrame, feeds: Sequence[str]) -> DataFrame:
    """Items per ticker and feed, tickers without any included, and the volume ratio."""
    p = items.groupBy("ticker").pivot("news_source", list(feeds)).count()
    j = universe.select("ticker").join(p, "ticker", "left").na.fill(0)
    a, b = (F.col(f"`{f}`") for f in feeds[:2])
    return j.withColumn("ratio", F.try_divide(b, a))


def coverage_gap(signals: DataFrame, history: DataFrame) -> DataFrame:
    """Share of signals from tickers with no history, and how many such tickers there are."""
    missing = signals.select("ticker").distinct().join(history.select("ticker").distinct(), "ticker", "left_anti")
    j = signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("k")).join(missing.withColumn("_m", F.lit(1)), "ticker", "left")
    return j.agg(F.count("_m").alias("n_missing_tickers"), F.coalesce(F.sum(F.when(F.col("_m") == 1, F.col("k"))), F.lit(0)).alias("n_signals_missing"), (F.coalesce(F.sum(F.when(F.col("_m") == 1, F.col("k"))), F.lit(0)) / F.sum("k")).alias("share"))


def shared_value_share(df: DataFrame, value: str) -> DataFrame:
    """Share of rows whose value occurs more than once, from counts per value."""
    c = df.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    return c.agg(F.sum("k").alias("n"), (F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("shared_share"))


def transitions(old: DataFrame, new: DataFrame, key: str, cls: str) -> DataFrame:
    j = old.select(key, F.col(cls).alias("old")).join(new.select(key, F.col(cls).alias("new")), key)
    return j.groupBy("old", "new").agg(n(), F.count_if(F.col("old") != F.col("new")).alias("n_flipped"))


def with_last_action(rows: DataFrame, actions: DataFrame, date: str, out: str = "last_ex_date") -> DataFrame:
    """The latest action date of the ticker on or before `date`, by one as-of join."""
    t = actions.select("ticker", F.col("ex_date").cast("timestamp").alias("_t")).distinct()
    return asof(rows.withColumn("_d", F.col(date).cast("timestamp")), t, ["ticker"], "_d", "_t", ["_t"], block=DAY, out="_a").withColumn(out, F.to_date("_a._t")).drop("_a", "_d")


def action_impact(rows: DataFrame, actions: DataFrame, date: str, value: str, look_back_days: int) -> DataFrame:
    """Count and median of a feature for rows whose look-back window spans an action, and for the others."""
    j = with_last_action(rows, actions, date, "_ex")
    j = j.withColumn("inside", F.coalesce(F.col("_ex") > F.date_sub(F.col(date), look_back_days), F.lit(False))).drop("_ex")
    return j.groupBy("inside").agg(n()).join(exact_quantiles(j, ["inside"], value, {"median": 0.5}), "inside", "left")


def actions_in_windows(windows: DataFrame, actions: DataFrame, start: str, end: str) -> DataFrame:
    """Return windows with `spans_action`: whether a split of the ticker falls after `start`, up to `end`."""
    j = with_last_action(windows, actions, end, "_ex")
    return j.withColumn("spans_action", F.coalesce(F.col("_ex") > F.col(start), F.lit(False))).drop("_ex")


def extreme_moves(daily: DataFrame, limit: float = 0.5) -> DataFrame:
    move = F.try_divide(F.col("c"), F.lag("c").over(Window.partitionBy("ticker").orderBy("d"))) - 1
    return daily.withColumn("move", move).filter(F.abs("move") > limit)


def dataset_summary(df: DataFrame, sigma: str) -> DataFrame:
    """Per ticker: events, those with sigma, and its median."""
    base = df.groupBy("ticker").agg(n(), F.count(sigma).alias("n_sigma"))
    return base.join(exact_quantiles(df, ["ticker"], sigma, {"median_sigma": 0.5}), "ticker", "left")


def sample_rows(df: DataFrame, key: str, row_id: str, k: int, seed: str) -> DataFrame:
    h = hash32(F.lit(seed), F.col(row_id).cast("string"))
    return top_per_key(df.withColumn("_h", h), [key], ["_h", row_id], k).drop("_h")


def group_means(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(n(), *[F.avg(v).alias(f"mean_{v}") for v in values])


def shadow_status(signals: DataFrame, t: str, entry_source: str) -> DataFrame:
    fired = F.col("status") == "fired"
    return signals.agg(
        n(), F.count_if(fired).alias("n_fired"), F.countDistinct(F.when(fired, et_day(t))).alias("active_days"), F.min(et_day(t)).alias("first_day"), F.max(et_day(t)).alias("last_day"),
        F.floor((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / F.lit(86400e6)).cast("int").alias("span_days"), F.avg(F.when(fired, (F.col(entry_source) != "live_trade").cast("double"))).alias("proxy_share"),
    )


def summary_only_fired(tagged_full: DataFrame, tagged_headline: DataFrame, key: str, fired: DataFrame) -> DataFrame:
    """Fired rows (`fired` has their keys) relevant by headline and summary but not by headline alone."""
    j = tagged_full.filter("relevance_tier < 3").select(key).join(tagged_headline.filter("relevance_tier < 3").select(key), key, "left_anti")
    return j.join(fired.select(key), key, "left_semi").agg(n())


def dataset_counts(tagged: DataFrame, typed: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """Rows by relevance tier and news type, and rows for which each named condition holds: (kind, value, n)."""
    tiers = tagged.groupBy(F.col("relevance_tier").cast("string").alias("value")).agg(n()).select(F.lit("tier").alias("kind"), "value", "n")
    types = typed.groupBy(F.col("news_type").alias("value")).agg(n()).select(F.lit("type").alias("kind"), "value", "n")
    checks = typed.agg(F.array(*[F.struct(F.lit(k).alias("value"), F.count_if(c).alias("n")) for k, c in valid.items()]).alias("_c"))
    return tiers.unionByName(types).unionByName(checks.select(F.inline("_c")).select(F.lit("valid").alias("kind"), "value", "n"))


def calibration_shape(steps: DataFrame) -> DataFrame:
    """Per class of a step table (class_id, x, y): breakpoints, output range and flat ranges."""
    w = Window.partitionBy("class_id").orderBy("x", "y")
    s = steps.withColumn("_flat", (F.col("y") == F.lag("y").over(w)).cast("int"))
    return s.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_breakpoints"), F.min("y").alias("min_out"), F.max("y").alias("max_out"), F.coalesce(F.sum("_flat"), F.lit(0)).alias("n_flat"))


def cohort_comparison(df: DataFrame, cohort: str, features: Sequence[str]) -> DataFrame:
    """Mean and median per feature of two cohorts (true/false) with the ratio of means."""
    long = df.select(cohort, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([cohort], list(features), "feature", "v")
    m = long.groupBy("feature").agg(F.avg(F.when(F.col(cohort), F.col("v"))).alias("mean_in"), F.avg(F.when(~F.col(cohort), F.col("v"))).alias("mean_out"))
    q = exact_quantiles(long, ["feature", cohort], "v", {"med": 0.5}).groupBy("feature").agg(F.max(F.when(F.col(cohort), F.col("med"))).alias("median_in"), F.max(F.when(~F.col(cohort), F.col("med"))).alias("median_out"))
    return m.join(q, "feature").withColumn("mean_ratio", F.try_divide("mean_in", "mean_out"))


def accuracy_range(df: DataFrame, by: str, hit: Column) -> DataFrame:
    return df.groupBy(by).agg(F.avg(hit.cast("double")).alias("acc")).agg(F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"))


def fire_rates(df: DataFrame, by: Sequence[str], prob: str) -> DataFrame:
    """Fire rate per class and mean probability, per population."""
    fired = F.col("status") == "fired"
    return df.groupBy(*by).agg(
        n(), *[F.avg((fired & (F.col("class_name") == c)).cast("double")).alias("fire_" + c.lower().replace(" ", "_")) for c in P.LONG_CLASSES], F.avg(prob).alias("mean_prob")
    )


def multi_symbol_share(signals: DataFrame, k: int = 1) -> DataFrame:
    fired = signals.filter("status = 'fired'")
    return fired.agg(n(), F.avg((F.col("n_symbols") >= 2).cast("double")).alias("multi_share"), F.count_if(F.col("n_symbols") <= k).alias(f"n_at_most_{k}"))


def merged_downtime(down: DataFrame, start: str, end: str, width: int = HOUR) -> DataFrame:
    """Merge overlapping intervals and cut the result at midnight (UTC): rows day, s, e."""
    m = merge_intervals(down, [], start, end, width)
    days = m.withColumn("day", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))))
    midnight, after = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    return days.select("day", F.greatest("s", midnight).alias("s"), F.least("e", after).alias("e")).filter("s < e")


def service_coverage(down: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Per session day: minutes down inside the session and the uptime share."""
    m = merged_downtime(down, start, end)
    s = sessions.withColumn("day", F.explode(F.sequence(F.to_date("sess_start"), F.to_date("sess_end"))))
    j = s.join(m, "day", "left")
    over = F.greatest(F.unix_micros(F.least("e", "sess_end")) - F.unix_micros(F.greatest("s", "sess_start")), F.lit(0))
    g = j.groupBy("d", "sess_start", "sess_end").agg((F.coalesce(F.sum(over), F.lit(0)) / F.lit(6e7)).alias("down_min"))
    total = (F.unix_micros("sess_end") - F.unix_micros("sess_start")) / F.lit(6e7)
    return g.select("d", "down_min", (1 - F.col("down_min") / total).alias("uptime"))


