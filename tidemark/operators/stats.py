"""Clustered statistics. Rows reduce to one row per cluster; only that small table is resampled.

Clusters are calendar days or months, so a cluster table has at most 366 rows per year and group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import params as P
from tidemark.functions.distributions import t_two_sided_p
from tidemark.functions.hashing import hash32
from tidemark.functions.scan import cumulative_counts, exact_quantiles, rank_rows
from tidemark.operators.labels import equal_count_bin
from tidemark.session import settle


#: Draws of a group that one row deals out.
DRAW_BLOCK = 100


def clusters(df: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Sum, count and mean per (group, cluster)."""
    return df.filter(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(
        F.sum(value).alias("c_sum"), F.count(F.lit(1)).alias("c_n"), F.avg(value).alias("c_mean"), F.count_if(F.col(value) < 0).alias("c_neg")
    )


def bootstrap_draws(cl: DataFrame, by: Sequence[str], cluster: str, n_boot: int, seed: str) -> DataFrame:
    """Resampled clusters: for draw b and slot i the cluster number is hash(seed, b, i) mod M."""
    by = list(by)
    rest = [c for c in cl.columns if c not in by]
    # A group's clusters are one array, bounded by the calendar. Draws are dealt in blocks, each with the array, and then
    # run inside generated code up to the caller's sums: no slot is shuffled or joined.
    known = cl.na.drop(subset=by) if by else cl
    groups = known.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(cluster, *(c for c in rest if c != cluster)))).alias("_c")).filter(F.size("_c") > 0)
    first = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(DRAW_BLOCK)))
    parts = int(cl.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not coalesced: the rows are few, their work is not
    blocks = groups.withColumn("_first", first).repartition(parts, *by, "_first")
    drawn = blocks.withColumn("b", F.explode(F.sequence("_first", F.least(F.col("_first") + DRAW_BLOCK, F.lit(n_boot)) - 1)))
    slots = drawn.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.size("_c").cast("long") - 1)))
    j = (hash32(F.lit(seed), F.col("b"), F.col("_i")) % F.size("_c")).cast("int")
    return slots.select(*by, "b", F.get("_c", j).alias("_c")).select(*by, *(F.col("_c")[c].alias(c) for c in rest), "b")


def _percentiles(draws: DataFrame, by: list[str]) -> DataFrame:
    """2.5/97.5 percentiles and share at or below zero; a group has only `n_boot` rows."""
    return draws.groupBy(*by).agg(
        F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg((F.col("m") <= 0).cast("double")).alias("p_le_0")
    )


def cluster_stats(df: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean of cluster means with its t, pooled mean and rows per cluster."""
    by = list(by)
    sd = F.stddev_samp("c_mean")
    return clusters(df, by, cluster, value).groupBy(*by).agg(
        F.sum("c_n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), (F.sum("c_sum") / F.sum("c_n")).alias("pooled_mean"),
        F.avg("c_mean").alias("cluster_mean"), F.when(sd > 0, F.avg("c_mean") / (sd / F.sqrt(F.count(F.lit(1))))).alias("t"), F.avg("c_n").alias("rows_per_cluster"),
    )


def cluster_bootstrap(df: DataFrame, by: Sequence[str], cluster: str, value: str, n_boot: int = 2000, seed: str = "42", ratio: bool = False) -> DataFrame:
    """Bootstrap of the mean of cluster means, or of sum over count with `ratio`."""
    by = list(by)
    d = bootstrap_draws(clusters(df, by, cluster, value), by, cluster, n_boot, seed)
    m = F.sum("c_sum") / F.sum("c_n") if ratio else F.avg("c_mean")
    return _percentiles(d.groupBy(*by, "b").agg(m.alias("m")), by)


def summarize(df: DataFrame, by: Sequence[str], cluster: str, value: str, n_boot: int = 2000, seed: str = "42") -> DataFrame:
    """n, clusters, both means, interval, negative share and a THIN flag."""
    by = list(by)
    cl = clusters(df, by, cluster, value)
    base = cl.groupBy(*by).agg(
        F.sum("c_n").alias("n"), F.count(F.lit(1)).alias("n_days"), F.avg("c_mean").alias("day_mean"), (F.sum("c_sum") / F.sum("c_n")).alias("pooled"), (F.sum("c_neg") / F.sum("c_n")).alias("neg_share")
    ).withColumn("thin", F.col("n") < P.THIN_N)
    draws = bootstrap_draws(cl, by, cluster, n_boot, seed).groupBy(*by, "b").agg(F.avg("c_mean").alias("m"))
    return base.join(_percentiles(draws, by).drop("p_le_0"), by)


def random_ticker_control(signals: DataFrame, returns: DataFrame, key: Sequence[str], n_draws: int = 1000, seed: str = "20261001", by: Sequence[str] = ()) -> DataFrame:
    """Replace each signal's return by that of another valid ticker over the same window, `n_draws` times.

    `signals` has `key` (window), ticker, signal_id, day; `returns` has `key`, ticker, adj. The valid
    tickers of a window form one array, bounded by the universe. One row per draw (and group `by` of the signals): its
    day-weighted mean. Every pair of window and ticker is priced once, before the draws: with draws in the hundreds
    and a universe of that size nearly every pair is drawn.
    """
    valid = returns.filter(F.col("adj").isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ticker", "adj"))).alias("v"))
    # The other tickers are picked once per signal. Draws then run inside generated code up to the partial sums, and the
    # array is read where it stands: only (draw, day) sums leave a task.
    others = F.filter("v", lambda x: x.ticker != F.col("ticker")).getField("adj")
    j = signals.join(valid, list(key)).select(*by, "day", "signal_id", others.alias("v")).filter(F.size("v") > 0)
    drawn = j.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    pick = (hash32(F.lit(seed), F.col("b"), F.col("signal_id")) % F.size("v")).cast("int")
    picked = drawn.select(*by, "b", "day", F.get("v", pick).alias("x"))
    per_day = picked.groupBy(*by, "b", "day").agg(F.avg("x").alias("dm"))
    return per_day.groupBy(*by, "b").agg(F.avg("dm").alias("draw_mean"))


def control_percentile(draws: DataFrame, real: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of draws below the real mean, ties half, with the draws' median and interval, per group `by`."""
    d = draws.withColumn("_r", real)
    below = F.when(F.col("draw_mean") < F.col("_r"), 1.0).when(F.col("draw_mean") == F.col("_r"), 0.5).otherwise(0.0)
    return d.groupBy(*by).agg(
        F.max("_r").alias("real_mean"), F.avg(below).alias("real_percentile"), F.percentile("draw_mean", F.lit(0.5)).alias("control_median"),
        F.percentile("draw_mean", F.lit(0.025)).alias("control_lo"), F.percentile("draw_mean", F.lit(0.975)).alias("control_hi"),
    )


def vs_zero(df: DataFrame, by: Sequence[str], month: str, value: str, n_boot: int = 10000, seed: str = "42") -> DataFrame:
    """Month-clustered test against zero with a ratio bootstrap, median and win share. The month table is settled."""
    by = list(by)
    cl = settle(clusters(df, by, month, value))
    sd = F.stddev_samp("c_mean")
    base = cl.groupBy(*by).agg(
        F.sum("c_n").alias("n"), F.count(F.lit(1)).alias("n_months"), (F.sum("c_sum") / F.sum("c_n")).alias("mean"),
        F.when(sd > 0, F.avg("c_mean") / (sd / F.sqrt(F.count(F.lit(1))))).alias("t"),
    )
    win = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("win"))
    med = exact_quantiles(df, by, value, {"median": 0.5})
    draws = bootstrap_draws(cl, by, month, n_boot, seed).groupBy(*by, "b").agg((F.sum("c_sum") / F.sum("c_n")).alias("m"))
    pct = _percentiles(draws, by).drop("p_le_0")
    if by:
        return base.join(win, by).join(med, by).join(pct, by)
    return base.select("*", win.scalar().alias("win"), med.scalar().alias("median"), pct.select("lo").scalar().alias("lo"), pct.select("hi").scalar().alias("hi"))


def ticker_mix_weights(population: DataFrame, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Population rows of event tickers, weighted so each ticker's weights sum to its event count.

    A ticker has at most one population row per day, so it is counted where its rows lie.
    """
    by = list(by)
    w_ev = events.groupBy(*by, "ticker").agg(F.count(F.lit(1)).alias("_e"))
    on = [*[c for c in by if c in population.columns], "ticker"]
    counted = population.withColumn("_p", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    return counted.join(w_ev, on).withColumn("w", F.try_divide(F.col("_e"), F.col("_p"))).drop("_e", "_p")


def _month_cells(events: DataFrame, population: DataFrame, by: list[str], month: str, y: str, w: str) -> DataFrame:
    e = events.filter(F.col(y).isNotNull()).groupBy(*by, month).agg(F.count(F.lit(1)).cast("double").alias("e_w"), F.sum(y).alias("e_y"))
    p = population.filter(F.col(y).isNotNull()).groupBy(*by, month).agg(F.sum(w).alias("p_w"), F.sum(F.col(w) * F.col(y)).alias("p_y"), F.count(F.lit(1)).alias("p_n"))
    return e.join(p, [*by, month], "full").na.fill(0.0, ["e_w", "e_y", "p_w", "p_y"]).na.fill(0, ["p_n"])


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of one-row statistics."""
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


def cell_mix_weights(population: DataFrame, events: DataFrame, by: Sequence[str], month: str, y: str, shared: Sequence[str] = ()) -> DataFrame:
    """Population weighted to each cell's mix of tickers, as one row per cell, ticker and month with the mean of y.

    The population is summed to ticker and month first, so cells never multiply its rows. Keys of `by` that the
    population has as well (a horizon) are `shared`.
    """
    by, on = list(by), ["ticker", *shared]
    w_ev = events.groupBy(*by, "ticker").agg(F.count(F.lit(1)).alias("_e"))
    sums = population.groupBy(*on, month).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    j = sums.withColumn("_p", F.sum("_n").over(Window.partitionBy(*on))).join(w_ev, on)
    return j.select(*by, "ticker", month, (F.col("_e") / F.col("_p") * F.col("_n")).alias("w"), (F.col("_s") / F.col("_n")).alias(y))


def weighted_diff_test(events: DataFrame, population: DataFrame, by: Sequence[str], month: str, y: str, w: str, n_boot: int = 10000, seed: str = "7") -> DataFrame:
    """Event mean minus weighted population mean with month-clustered (CR1) error and bootstrap interval.

    With an intercept and one indicator the sandwich reduces to the month sums of weighted residuals
    of both sides, so one pass of month sums carries everything; it is settled, as every later step reads it.
    """
    by = list(by)
    cells = settle(_month_cells(events, population, by, month, y, w))
    tot = cells.groupBy(*by).agg(
        F.sum("e_w").alias("We"), F.sum("p_w").alias("Wp"), F.try_divide(F.sum("e_y"), F.sum("e_w")).alias("mean_e"), F.try_divide(F.sum("p_y"), F.sum("p_w")).alias("mean_p"), F.count(F.lit(1)).alias("G"), F.sum("p_n").alias("n_p")
    )
    j = cells.join(tot, by) if by else cells.withColumn("_t", tot.select(F.struct("*")).scalar()).select(*cells.columns, "_t.*")
    s = F.try_divide(F.col("e_y") - F.col("e_w") * F.col("mean_e"), F.col("We")) - F.try_divide(F.col("p_y") - F.col("p_w") * F.col("mean_p"), F.col("Wp"))
    meat = j.groupBy(*by, "G", "We", "n_p", "mean_e", "mean_p").agg(F.sum(s * s).alias("_meat"))
    res = meat.withColumn("diff", F.col("mean_e") - F.col("mean_p")).withColumn(
        "se", F.sqrt(F.when(F.col("G") > 1, F.col("G") / (F.col("G") - 1) * F.col("_meat")))
    ).withColumn("t", F.when(F.col("se") > 0, F.try_divide(F.col("diff"), F.col("se"))))
    draws = bootstrap_draws(cells, by, month, n_boot, seed).groupBy(*by, "b").agg(F.sum("e_y").alias("ey"), F.sum("e_w").alias("ew"), F.sum("p_y").alias("py"), F.sum("p_w").alias("pw"))
    draws = draws.filter("ew > 0 AND pw > 0").withColumn("m", F.try_divide(F.col("ey"), F.col("ew")) - F.try_divide(F.col("py"), F.col("pw")))
    pct = _percentiles(draws, by).drop("p_le_0")
    out = res.join(pct, by) if by else res.withColumn("_p", pct.select(F.struct("*")).scalar()).select(*res.columns, "_p.lo", "_p.hi")
    return out.select(*by, F.col("We").cast("long").alias("n_e"), "n_p", "G", "mean_e", "mean_p", "diff", "se", "t", "lo", "hi", student_p("t", (F.col("G") - 1).cast("double")).alias("p"))


def study_cells(scored: DataFrame) -> DataFrame:
    """Events repeated once per overlapping analysis cell they belong to."""
    vol = ~F.col("is_10b5_1")
    cell = [
        F.lit("all"), F.when(vol, "voluntary"), F.when(~vol, "planned"), F.when(vol, F.concat(F.lit("role="), "role")),
        F.when(vol, F.concat(F.lit("size="), "size_bucket")), F.when(vol, F.concat(F.lit("cluster="), F.col("is_cluster").cast("string"))),
    ]
    return scored.withColumn("cell", F.explode(F.filter(F.array(*cell), lambda c: c.isNotNull())))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank with ties averaged, from the counts of distinct values (equal values are combined first)."""
    counts = df.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative_counts(counts, [])
    return df.join(ranked.select(F.col("_v").alias(value), (F.col("_end") - (F.col("_n") - 1) / 2).alias(out)), value)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson and rank correlation."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    r = average_ranks(average_ranks(d, x, "_rx"), y, "_ry")
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def decile_means(df: DataFrame, score: str, value: str, tie: str, k: int = 10) -> DataFrame:
    d = df.filter(F.col(score).isNotNull() & F.col(value).isNotNull())
    n = d.agg(F.count(F.lit(1))).scalar()
    b = rank_rows(d, [], score, tie, out="_p").withColumn("bin", equal_count_bin(F.col("_p"), n, k))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def top_minus_bottom(deciles: DataFrame) -> DataFrame:
    return deciles.agg((F.max_by("mean", "bin") - F.min_by("mean", "bin")).alias("spread"))


def value_bands(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    band = F.when(v <= -0.6, "<=-0.6").when(v <= -0.2, "-0.6..-0.2").when(v <= 0.2, "-0.2..+0.2").when(v <= 0.6, "+0.2..+0.6").otherwise(">+0.6")
    return df.filter(v.isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(((v > -0.05) & (v < 0.05)).cast("double")).alias("near_zero"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sd and the five-number summary, exact."""
    q = exact_quantiles(df, [], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    base = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return base.withColumn("_q", q.select(F.struct("*")).scalar()).select("n", "mean", "sd", "min", "_q.q25", "_q.median", "_q.q75", "max")


def two_constructions(a: DataFrame, b: DataFrame, keys: Sequence[str], va: str, vb: str) -> DataFrame:
    j = a.join(b, list(keys)).filter(F.col(va).isNotNull() & F.col(vb).isNotNull())
    return j.agg(F.count(F.lit(1)).alias("n_matched"), F.avg(F.abs(F.col(va) - F.col(vb))).alias("mean_abs_diff"), F.corr(va, vb).alias("corr"))


def market_decomposition(df: DataFrame, by: Sequence[str], raw: str, bench: str, beta: str) -> DataFrame:
    part = F.col(beta) * F.col(bench)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(raw).alias("raw"), F.avg(bench).alias("benchmark"), F.avg(part).alias("beta_part"), F.avg(F.col(raw) - part).alias("adjusted")
    )


def equal_month_diff(events: DataFrame, population: DataFrame, month: str, y: str) -> DataFrame:
    e = events.filter(F.col(y).isNotNull()).groupBy(month).agg(F.avg(y).alias("e"))
    p = population.filter(F.col(y).isNotNull()).groupBy(month).agg(F.avg(y).alias("p"))
    d = e.join(p, month).withColumn("d", F.col("e") - F.col("p"))
    return d.agg(F.count(F.lit(1)).alias("n_months"), F.avg("d").alias("mean_diff"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def pooled_versus_daily(df: DataFrame, day: str, value: str) -> DataFrame:
    cl = clusters(df, [], day, value)
    return cl.agg(
        F.sum("c_n").alias("n"), (F.sum("c_sum") / F.sum("c_n")).alias("pooled_mean"), F.avg("c_mean").alias("mean_of_day_means"),
        (F.sum(F.when(F.col("c_mean") < 0, F.col("c_n")).otherwise(0)) / F.sum("c_n")).alias("share_on_negative_days"),
    )


def sampled_baseline(eligible: DataFrame, events: DataFrame, date: str, per_event: int = 3, seed: str = "baseline") -> DataFrame:
    """About `per_event` random eligible dates per event of the ticker, by hash order.

    Ticker-days are at most one per day, so ranking inside a ticker is bounded by the calendar.
    """
    want = events.groupBy("ticker").agg((F.count(F.lit(1)) * per_event).alias("_k"))
    h = hash32(F.lit(seed), F.col("ticker"), F.col(date).cast("string"))
    w = Window.partitionBy("ticker").orderBy("_h", date)
    r = eligible.withColumn("_h", h).withColumn("_r", F.row_number().over(w))
    return r.join(want, "ticker").filter(F.col("_r") <= F.col("_k")).drop("_h", "_r", "_k")
