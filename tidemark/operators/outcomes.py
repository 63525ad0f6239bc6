"""What price did after an entry: stop exits, returns, benchmark excess and trade summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.hashing import hash32
from tidemark.functions.scan import HOUR, asof, exact_quantiles, first_per_key, rank_rows, running_sums, time_block
from tidemark.operators.align import after, entry_bar, with_exit, with_session


# ---- stop exits -------------------------------------------------------------------------------------
def _first_bar(windows: DataFrame, bars: DataFrame, some: Callable[[Column, Column], Column], each: Column, block: int) -> DataFrame:
    """Per distinct window (ticker, entry_idx, exit_idx and the columns that the conditions name) the first bar that meets
    `each`, as struct `_bar`; windows without one drop.

    Blocks of bars have a summary, their lowest low and highest high. A window meets the summaries of its blocks in an
    equi-join, and `some(low, high)` says whether a block can hold such a bar. Opened are only the block that holds the
    window's first bar, its last one, and the first block between them that can; the two at the ends may also hold bars
    outside the window, the one between holds the bar if the summary says so.
    """
    keys = windows.columns
    place = F.floor(F.col("idx") / block).cast("long")
    levels = bars.groupBy("ticker", place.alias("_blk")).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    first, last = (F.floor(F.col(c) / block).cast("long") for c in ("entry_idx", "exit_idx"))
    dealt = windows.withColumn("_blk", F.explode(F.sequence(first, F.greatest(first, last))))
    able = dealt.join(levels, ["ticker", "_blk"]).filter(some(F.col("_low"), F.col("_high")))
    end = (F.col("_blk") == first) | (F.col("_blk") == last)
    opened = able.groupBy(*keys).agg(F.collect_set(F.when(end, F.col("_blk"))).alias("_ends"), F.min(F.when(~end, F.col("_blk"))).alias("_mid"))
    opened = opened.withColumn("_blk", F.explode(F.array_distinct(F.array_compact(F.concat("_ends", F.array("_mid"))))))
    met = opened.join(bars.select("ticker", place.alias("_blk"), "idx", "ts", "open", "high", "low", "close"), ["ticker", "_blk"])
    met = met.filter((F.col("idx") >= F.col("entry_idx")) & (F.col("idx") <= F.col("exit_idx")) & each)
    return met.groupBy(*keys).agg(F.min_by(F.struct("ts", "open", "high", "low", "close"), "idx").alias("_bar"))


def _with_path(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades whose ticker has bars from the entry on."""
    newest = bars.groupBy("ticker").agg(F.max("idx").alias("_newest"))
    return trades.join(newest, "ticker").filter(F.col("entry_idx") <= F.col("_newest"))


def first_touch_exit(trades: DataFrame, bars: DataFrame, block: int = 32) -> DataFrame:
    """Exit at the first bar of [entry, exit] that touches the stop, else at the planned exit.

    `trades` has entry_idx, exit_idx, entry_price, exit_price, direction, stop_dist; a missing or
    non-positive stop distance never stops. A gap through the stop fills at the open.
    Only distinct windows are searched; the wide rows move once, in the closing join.
    """
    sd = F.when((F.col("stop_dist") > 0) & ~F.isnan("stop_dist") & (F.col("stop_dist") < float("inf")), F.col("stop_dist"))
    t = _with_path(trades, bars).drop("_newest").withColumn("_long", F.col("direction") == "long").withColumn(
        "_stop", F.when(F.col("_long"), F.col("entry_price") - sd).otherwise(F.col("entry_price") + sd)
    )
    lng, stop = F.col("_long"), F.col("_stop")
    keys = ["ticker", "entry_idx", "exit_idx", "_long", "_stop"]

    def touch(low: Column, high: Column) -> Column:
        return F.coalesce(F.when(lng, low <= stop).otherwise(high >= stop), F.lit(False))

    hits = _first_bar(t.filter("_stop IS NOT NULL").select(*keys).distinct(), bars, touch, touch(F.col("low"), F.col("high")), block)
    j = t.join(hits, keys, "left")
    fill = F.when(lng, F.least(F.col("_bar.open"), stop)).otherwise(F.greatest(F.col("_bar.open"), stop))
    return j.withColumn("stopped", F.col("_bar").isNotNull()).withColumn(
        "exit_fill", F.when(F.col("stopped"), fill).otherwise(F.col("exit_price"))
    ).select(*trades.columns, "stopped", "exit_fill")


def short_circuit_exit(trades: DataFrame, bars: DataFrame, block: int = 32) -> DataFrame:
    """The live variant: only the first bar not wholly below the stop decides; it stops only if the
    stop lies inside that bar. Kept for comparison with `first_touch_exit`. Null stop: never stops."""
    stop = F.col("stop_price")
    keys = ["ticker", "entry_idx", "exit_idx", "stop_price"]
    t = _with_path(trades, bars)
    # A bar without a high is not wholly below: a block that may hold one is opened.
    whole = bars.withColumn("high", F.coalesce("high", F.lit(float("inf"))))
    deciders = _first_bar(t.filter("stop_price IS NOT NULL").select(*keys).distinct(), whole, lambda low, high: high >= stop, F.col("high") >= stop, block)
    ends = bars.select("ticker", F.col("idx").alias("_end"), F.struct("ts", "close").alias("_last"))
    j = t.withColumn("_end", F.when(F.col("exit_idx") >= F.col("entry_idx"), F.least("exit_idx", "_newest"))).join(ends, ["ticker", "_end"], "left").join(deciders, keys, "left")
    hit = F.coalesce((F.col("_bar.low") <= stop) & (stop <= F.col("_bar.high")), F.lit(False))
    return j.withColumn("stopped", hit).withColumn("exit_price", F.when(hit, stop).otherwise(F.col("_last.close"))).withColumn(
        "exit_ts", F.when(hit, F.col("_bar.ts")).otherwise(F.col("_last.ts"))
    ).select(*[c for c in trades.columns if c not in ("exit_price", "exit_ts")], "stopped", "exit_price", "exit_ts")


def wall_clock_window(trades: DataFrame, bars: DataFrame, t: str, minutes: int = P.HORIZON_BARS) -> DataFrame:
    """Bar numbers of the first bar at or after `t` and at or after `t` + minutes; unresolved rows drop."""
    e = trades.withColumn("_x", after(t, minutes))
    a = asof(e, bars, ["ticker"], t, "ts", ["idx"], forward=True, out="_a")
    z = asof(a, bars, ["ticker"], "_x", "ts", ["idx"], forward=True, out="_z")
    return z.filter(F.col("_a").isNotNull() & F.col("_z").isNotNull()).withColumn("entry_idx", F.col("_a.idx")).withColumn(
        "exit_idx", F.col("_z.idx")
    ).drop("_a", "_z", "_x")


# ---- returns --------------------------------------------------------------------------------------------
def trade_returns(df: DataFrame, entry: str = "entry_price", exit_: str = "exit_fill", bps: float = P.SLIPPAGE_BPS) -> DataFrame:
    slip = bps / 1e4
    e, x, lng = F.col(entry), F.col(exit_), F.col("direction") == "long"
    gross = F.when(lng, F.try_divide(x, e) - 1).otherwise(1 - F.try_divide(x, e))
    net = F.when(lng, F.try_divide(x * (1 - slip), e * (1 + slip)) - 1).otherwise(1 - F.try_divide(x * (1 + slip), e * (1 - slip)))
    return df.withColumn("gross_ret", gross).withColumn("net_ret", net)


def benchmark_excess(trades: DataFrame, bench_bars: DataFrame, t0: str, t1: str) -> DataFrame:
    """Benchmark open at or after entry to close at or after exit, and the signed excess."""
    spans = trades.select(t0, t1).distinct()
    a = asof(spans, bench_bars, [], t0, "ts", ["open"], forward=True, out="_a")
    z = asof(a, bench_bars, [], t1, "ts", ["close"], forward=True, out="_z")
    found = z.select(t0, t1, (F.try_divide(F.col("_z.close"), F.col("_a.open")) - 1).alias("bench_gross"))
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    return trades.join(found, [t0, t1], "left").withColumn("excess_gross", F.col("gross_ret") - sign * F.col("bench_gross"))


def stop_level(df: DataFrame, atr_pct: str, multiple: float = P.STOP_ATR_MULTIPLE) -> DataFrame:
    level = F.col("entry_price") * (1 - F.lit(multiple) * F.col(atr_pct))
    return df.withColumn("stop_price", F.when(F.col("class_name").isin(*P.LONG_CLASSES), level))


# ---- summaries ---------------------------------------------------------------------------------------------
def max_drawdown(trades: DataFrame, by: Sequence[str], t: str, tie: str, ret: str, width: int = HOUR) -> DataFrame:
    """Largest fall of the running return sum from its running peak.

    Scanned in time blocks of `width` microseconds, whatever the trades in a day: a block's own sums and peaks meet the sum
    and the peak of the blocks before it. The width only decides how work is cut.
    """
    by = list(by)
    block = time_block(t, width)
    cum = running_sums(trades.select(*by, t, tie, ret), by, [t, tie], block, {"_cum": F.col(ret)}).withColumn("_blk", block)
    peaks = cum.groupBy(*by, "_blk").agg(F.max("_cum").alias("_pk"))
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = peaks.select(*by, "_blk", F.max("_pk").over(before).alias("_before"))
    inner = Window.partitionBy(*by, "_blk").orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("_cum").over(inner), F.col("_before"))
    return cum.join(carry, [*by, "_blk"]).withColumn("_dd", peak - F.col("_cum")).groupBy(*by).agg(F.max("_dd").alias("max_drawdown"))


def _t_stat(c: str) -> Column:
    sd = F.stddev_samp(c)
    return F.when(sd > 0, F.avg(c) / (sd / F.sqrt(F.count(c))))


def trade_summary(trades: DataFrame, by: Sequence[str], t: str, tie: str) -> DataFrame:
    """n, win, mean, median, sum, t, drawdown, stop share, long/short and severity splits, excess."""
    by = list(by)

    def mean_if(cond: Column) -> Column:
        return F.avg(F.when(cond, F.col("net_ret")))

    lng, sev = F.col("direction") == "long", F.col("severe")
    base = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("net_ret") > 0).cast("double")).alias("win"), F.avg("net_ret").alias("mean"), F.sum("net_ret").alias("sum"),
        _t_stat("net_ret").alias("t"), F.avg("gross_ret").alias("gross_mean"), F.avg(F.col("stopped").cast("double")).alias("stop_share"),
        F.count_if(lng).alias("n_long"), mean_if(lng).alias("mean_long"), F.count_if(~lng).alias("n_short"), mean_if(~lng).alias("mean_short"),
        F.count_if(sev).alias("n_severe"), mean_if(sev).alias("mean_severe"), mean_if(~sev).alias("mean_nonsevere"), F.avg("excess").alias("excess_mean"), _t_stat("excess").alias("excess_t"),
    )
    med = exact_quantiles(trades, by, "net_ret", {"median": 0.5})
    return base.join(med, by).join(max_drawdown(trades, by, t, tie, "net_ret"), by)


def backtest(decisions: DataFrame, bars: DataFrame, bench_bars: DataFrame, t: str, horizon: int = P.HORIZON_BARS) -> DataFrame:
    """From decisions to trades: entry at the first bar at or after `t`, first-touch exit within `horizon` bars, gross and
    net return, benchmark return and signed excess. Decisions without a whole horizon of bars drop.

    `decisions` has ticker, `t`, direction and stop_share (stop distance as a share of the entry price, null for none);
    its other columns are kept. `trade_summary` by strategy makes the report.
    """
    x = with_exit(bars, horizon).withColumn("exit_idx", F.when(F.col("exit_ts").isNotNull(), F.col("idx") + horizon))
    found = entry_bar(decisions, x, t, ["ts", "idx", "open", "exit_idx", "exit_ts", "exit_price"]).filter("bar.exit_idx IS NOT NULL")
    trades = found.select(
        *decisions.columns, F.col("bar.ts").alias("entry_ts"), F.col("bar.idx").alias("entry_idx"), F.col("bar.open").alias("entry_price"), "bar.exit_idx", "bar.exit_ts", "bar.exit_price",
        (F.col("bar.open") * F.col("stop_share")).alias("stop_dist"),
    )
    priced = benchmark_excess(trade_returns(first_touch_exit(trades, x)), bench_bars, "entry_ts", "exit_ts")
    return priced.withColumnRenamed("excess_gross", "excess")


def random_trades(pool: DataFrame, key: str, n: Column, seed: str) -> DataFrame:
    """`n` rows drawn without replacement by hash order, each with a random side."""
    h = pool.withColumn("_h", hash32(F.lit(seed), F.col(key).cast("string")))
    drawn = rank_rows(h, [], "_h", key, out="_p").filter(F.col("_p") <= n)
    side = F.when(hash32(F.lit(seed + "-side"), F.col(key).cast("string")) % 2 == 0, "long").otherwise("short")
    return drawn.withColumn("direction", side).drop("_h", "_p")


def sentiment_trades(events: DataFrame, score: str, cut: float = 0.5) -> DataFrame:
    side = F.when(F.col(score) > cut, "long").when(F.col(score) < -cut, "short")
    return events.withColumn("direction", side).filter("direction IS NOT NULL")


def distinct_entries(trades: DataFrame, entry: str, tie: str) -> DataFrame:
    """One trade per (ticker, entry time): coincident trades are the same position."""
    return first_per_key(trades, ["ticker", entry], [tie])


def next_session_outcomes(df: DataFrame, t0: str, t1: str, sessions: DataFrame) -> DataFrame:
    """Flag outcomes whose exit lies in another session than their start."""
    a = with_session(df, t0, sessions).withColumnRenamed("sess_start", "_s0").drop("sess_end")
    z = with_session(a, t1, sessions).withColumnRenamed("sess_start", "_s1").drop("sess_end")
    return z.withColumn("rolled", F.col("_s0").isNotNull() & ~F.col("_s0").eqNullSafe(F.col("_s1"))).drop("_s0", "_s1")


def alert_reconciliation(fired: DataFrame, alert: str, label: str, ret: str) -> DataFrame:
    """Per alert class: size, share per true class, mean return per true class, precision, win rate."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(alert)).cast("double")).alias("precision"), F.avg((F.col(ret) > 0).cast("double")).alias("win"), F.avg(ret).alias("mean_ret")]
    for k in range(4):
        aggs += [F.count_if(F.col(label) == k).alias(f"n_true_{k}"), F.avg(F.when(F.col(label) == k, F.col(ret))).alias(f"mean_true_{k}")]
    return fired.groupBy(alert).agg(*aggs)
