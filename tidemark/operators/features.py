"""Point-in-time features: bars, indicators, regime, news flow, volatility and beta.

Bar-side windows partition by ticker (rows per ticker are bounded by the clock, see `align`). The
event side reads them through as-of joins only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.scan import DAY, HOUR, asof, micros, running_sums, time_block
from tidemark.operators.align import with_session
from tidemark.session import settle

ET = "America/New_York"


def _rows(n: int, *, by: str = "ticker", order: str = "ts", last: int = 0):
    """Frame of the `n` rows ending `-last` rows before the current one."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(last - n + 1, last)


def _full(value: Column, n: int, frame, probe: Column) -> Column:
    """`value` only where the frame holds `n` non-null probes."""
    return F.when(F.count(probe).over(frame) >= n, value)


# ---- hourly bars and indicators -----------------------------------------------------------------------
def hourly_bars(bars: DataFrame) -> DataFrame:
    return (
        bars.groupBy("ticker", F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        )
        .filter(F.col("close").isNotNull())
    )


def ema(df: DataFrame, value: str, alpha: float, out: str, order: str = "ts", by: str = "ticker") -> DataFrame:
    """Recursive mean y = a*x + (1-a)*y_prev, seeded by the first non-null value, without a row loop.

    Inside a block of rows the recursion is a sum weighted by powers of (1-a). The block is so long
    that (1-a)^span is below double precision, so the state entering a block is the sum of the one
    block before it, and older blocks no longer count. Nulls may only come before the first value.
    """
    d = 1.0 - alpha
    span = math.ceil(math.log(1e-19) / math.log(d))
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_i", F.count(value).over(upto) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_i") / span)).withColumn("_k", F.pmod(F.col("_i"), F.lit(span)))
    x = F.when(F.col("_i") == 0, F.col(value)).otherwise(F.col(value) * alpha)
    inner = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_l", F.sum(x * F.pow(F.lit(d), -F.col("_k"))).over(inner) * F.pow(F.lit(d), F.col("_k")))
    block_end = F.when(F.col("_k") == span - 1, F.col("_l"))
    rows = rows.withColumn("_c", F.last(block_end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn(
        out, F.col("_l") + F.coalesce(F.col("_c"), F.lit(0.0)) * F.pow(F.lit(d), F.col("_k") + 1)
    ).drop("_i", "_b", "_k", "_l", "_c")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("ts")))


def rsi(h: DataFrame, n: int = P.RSI_PERIOD, out: str = "rsi") -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts")
    diff = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
    moves = _numbered(h).withColumn("_up", F.greatest(diff, F.lit(0.0))).withColumn("_dn", F.greatest(-diff, F.lit(0.0)))
    both = ema(ema(moves, "_up", 1.0 / n, "_eu"), "_dn", 1.0 / n, "_ed")
    value = F.when(F.col("_ed") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_eu") / F.when(F.col("_ed") != 0, F.col("_ed"))))
    return both.withColumn(out, F.when(F.col("_n") >= n, value)).drop("_up", "_dn", "_eu", "_ed", "_n")


def macd_hist(h: DataFrame, fast: int = P.MACD_FAST, slow: int = P.MACD_SLOW, signal: int = P.MACD_SIGNAL, out: str = "macd_hist") -> DataFrame:
    """MACD minus its signal line, over close; null during warm-up."""
    e = ema(ema(_numbered(h), "close", 2.0 / (fast + 1), "_f"), "close", 2.0 / (slow + 1), "_s")
    line = e.withColumn("_m", F.when(F.col("_n") >= slow, F.col("_f") - F.col("_s")))
    joined = ema(line, "_m", 2.0 / (signal + 1), "_g")
    value = F.try_divide(F.col("_m") - F.col("_g"), F.col("close"))
    return joined.withColumn(out, F.when(F.col("_n") >= slow + signal - 1, value)).drop("_f", "_s", "_m", "_g", "_n")


def bollinger(h: DataFrame, n: int = P.BB_PERIOD, k: float = P.BB_STD) -> DataFrame:
    f = _rows(n)
    mid, sd = F.avg("close").over(f), F.stddev_pop("close").over(f)
    rows = h.withColumn("_mid", _full(mid, n, f, F.col("close"))).withColumn("_sd", _full(sd, n, f, F.col("close")))
    width = F.when(F.col("_sd") > 0, 2 * k * F.col("_sd"))
    return rows.withColumn("bb_pctb", (F.col("close") - (F.col("_mid") - k * F.col("_sd"))) / width).withColumn(
        "bb_width", F.try_divide(width, F.col("close"))
    ).drop("_mid", "_sd")


def atr(h: DataFrame, n: int = P.ATR_PERIOD, out: str = "atr_pct") -> DataFrame:
    """Simple mean of the true range over close."""
    prev = F.lag("close").over(Window.partitionBy("ticker").orderBy("ts"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    rows = h.withColumn("_tr", tr)
    f = _rows(n)
    return rows.withColumn(out, F.try_divide(_full(F.avg("_tr").over(f), n, f, F.col("_tr")), F.col("close"))).drop("_tr")


INDICATORS = ["rsi", "macd_hist", "bb_pctb", "bb_width", "atr_pct"]


def hourly_indicators(h: DataFrame) -> DataFrame:
    return atr(bollinger(macd_hist(rsi(h))))


def last_completed_hour(events: DataFrame, hourly: DataFrame, t: str, columns: Sequence[str], min_bars: int = P.MIN_HOURLY_BARS, out: str = "hb") -> DataFrame:
    """Last hourly bar that ended strictly before the event; null with fewer than `min_bars` of history."""
    ended = _numbered(hourly).withColumn("hour_end", F.timestamp_micros(micros("ts") + HOUR)).filter(F.col("_n") >= min_bars)
    return asof(events, ended, ["ticker"], t, "hour_end", list(columns), exact=False, block=DAY, out=out)


def session_vwap(events: DataFrame, bars: DataFrame, sessions: DataFrame, t: str) -> DataFrame:
    """VWAP over [session start, t) and distance of the last close to it; null outside a session."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    w = Window.partitionBy("ticker", "sess_start").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    running = with_session(bars, "ts", sessions, "inner").select(
        "ticker", "sess_start", "ts", "close",
        F.sum(typical * F.col("volume")).over(w).alias("pv"), F.sum("volume").over(w).cast("double").alias("vol"),
    )
    inside = with_session(events, t, sessions)
    j = asof(inside, running, ["ticker", "sess_start"], t, "ts", ["close", "pv", "vol"], exact=False, out="_v")
    vwap = F.when(F.col("_v.vol") > 0, F.try_divide(F.col("_v.pv"), F.col("_v.vol")))
    return j.withColumn("vwap", vwap).withColumn(
        "dist_from_vwap", F.when(F.col("vwap") > 0, F.try_divide(F.col("_v.close"), F.col("vwap")) - 1)
    ).drop("_v", "sess_start", "sess_end")


def technical_features(events: DataFrame, bars: DataFrame, sessions: DataFrame, t: str) -> DataFrame:
    """Indicators of the last completed hour and the session VWAP distance; `hb` is null in warm-up.

    Bars and hourly bars are settled first: each of the as-of sides and running means would scan them again.
    """
    bars = settle(bars)
    ind = hourly_indicators(settle(hourly_bars(bars)))
    return session_vwap(last_completed_hour(events, ind, t, INDICATORS), bars, sessions, t)


# ---- daily regime ------------------------------------------------------------------------------------------
def daily_closes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.max_by("close", "ts").alias("c"))


def benchmark_regime(bench: DataFrame, fast: int = P.SMA_FAST, slow: int = P.SMA_SLOW, min_days: int = 30) -> DataFrame:
    """Per benchmark day: distance to the two moving averages and the above-slow flag."""
    def frame(n):
        return Window.orderBy("d").rowsBetween(-n + 1, 0)

    rows = bench.withColumn("_n", F.row_number().over(Window.orderBy("d")))
    for name, n in (("_f", fast), ("_s", slow)):
        rows = rows.withColumn(name, F.when(F.col("_n") >= n, F.avg("c").over(frame(n))))
    return rows.filter(F.col("_n") >= min_days).select(
        "d", (F.try_divide(F.col("c"), F.col("_f")) - 1).alias("dist_sma_fast"), (F.try_divide(F.col("c"), F.col("_s")) - 1).alias("dist_sma_slow"),
        (F.col("c") > F.col("_s")).cast("int").alias("above_slow"),
    )


def ticker_regime(daily: DataFrame, short: int = P.VOL_SHORT_DAYS, long: int = P.VOL_LONG_DAYS) -> DataFrame:
    """Per ticker-day: short realised vol, short/long ratio and momentum; only with long+2 closes."""
    w = Window.partitionBy("ticker").orderBy("d")
    rows = daily.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.ln(F.try_divide(F.col("c"), F.lag("c").over(w))))
    sf, lf = (Window.partitionBy("ticker").orderBy("d").rowsBetween(-n + 1, 0) for n in (short, long))
    rows = rows.withColumn("rv_short", F.stddev_samp("_r").over(sf)).withColumn("_rl", F.stddev_samp("_r").over(lf))
    rows = rows.withColumn("mom", F.try_divide(F.col("c"), F.lag("c", 5).over(w)) - 1)
    ok = (F.col("_n") >= long + 2) & (F.col("rv_short") >= 0) & (F.col("_rl") > 0)
    return rows.filter(ok).select("ticker", "d", "rv_short", (F.try_divide(F.col("rv_short"), F.col("_rl"))).alias("vol_ratio"), "mom")


def prior_day(events: DataFrame, daily: DataFrame, t: str, columns: Sequence[str], by: Sequence[str] = ("ticker",), out: str = "pd") -> DataFrame:
    """Daily row with a date strictly before the event's UTC date."""
    e = events.withColumn("_date", F.to_date(t))
    return asof(e, daily, list(by), "_date", "d", list(columns), exact=False, block=None, out=out).drop("_date")


def prior_valid_day(events: DataFrame, daily: DataFrame, regime: DataFrame, t: str, columns: Sequence[str], out: str = "pd") -> DataFrame:
    """As `prior_day`, but the regime must be defined on that very day (no older fallback)."""
    all_days = daily.select("ticker", "d").join(
        regime.select("ticker", "d", F.struct(*columns).alias("_v")), ["ticker", "d"], "left"
    )
    return prior_day(events, all_days, t, ["_v"], out="_p").withColumn(out, F.col("_p._v")).drop("_p")


def sector_momentum(events: DataFrame, universe: DataFrame, mom: str, t: str) -> DataFrame:
    """Mean momentum of the events of a UTC date and sector, and the event's difference to it.

    The mean is aggregated and joined back (not a window), so a busy sector-day is combined map-side.
    """
    e = events.join(universe.select("ticker", "sector"), "ticker", "left").withColumn("_date", F.to_date(t))
    means = e.filter(F.col(mom).isNotNull()).groupBy("_date", "sector").agg(F.avg(mom).alias("sector_mean_mom"))
    j = e.join(means, ["_date", "sector"], "left").drop("_date")
    j = j.withColumn("sector_mean_mom", F.when(F.col(mom).isNotNull(), F.col("sector_mean_mom")))
    return j.withColumn("sector_rel_mom", F.col(mom) - F.col("sector_mean_mom"))


def peer_momentum(universe: DataFrame, daily: DataFrame, dates: DataFrame, min_days: int = 6) -> DataFrame:
    """Per (sector, date): mean over sector tickers of the momentum of their last earlier day.

    A day's momentum holds on the dates after it up to the ticker's next day. It is summed into the days of this span or,
    where the span holds whole stretches of days, into these; a date adds its day and its stretch. So no ticker meets all
    wanted dates, sums by sector and day leave the tasks, and nothing is subtracted.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    mom = daily.select(
        "ticker", "d", F.row_number().over(w).alias("_n"), (F.try_divide(F.col("c"), F.lag("c", 5).over(w)) - 1).alias("mom"), F.lead("d").over(w).alias("_next")
    ).filter((F.col("_n") >= min_days) & F.col("d").isNotNull() & F.col("mom").isNotNull())
    newest = dates.agg(F.max(F.unix_date("date"))).scalar()
    spans = mom.select("ticker", "mom", (F.unix_date("d") + 1).alias("_a"), F.least(F.unix_date("_next"), newest).alias("_z")).filter("_a <= _z")
    named = spans.join(universe.select("sector", "ticker").distinct(), "ticker")

    # Even numbers are days, odd ones stretches. Fixed value: days of a stretch.
    width = 32
    a, z = F.col("_a"), F.col("_z")
    first, end = F.ceil(a / F.lit(width)).cast("int"), F.floor((z + 1) / F.lit(width)).cast("int")

    def numbers(lo: Column, hi: Column, odd: int) -> Column:
        return F.when(lo <= hi, F.sequence(lo * 2 + odd, hi * 2 + odd, F.lit(2))).otherwise(F.array().cast("array<int>"))

    cut = F.concat(numbers(a, first * width - 1, 0), numbers(first, end - 1, 1), numbers(end * width, z, 0))
    parts = F.when(first < end, cut).otherwise(numbers(a, z, 0))
    sums = named.select("sector", "mom", F.explode(parts).alias("_i")).groupBy("sector", "_i").agg(F.sum("mom").alias("_s"), F.count("mom").alias("_k"))
    held = universe.filter(F.col("ticker").isNotNull()).select("sector").distinct()
    day = F.unix_date("date")
    wanted = dates.select("sector", "date").distinct().join(held, "sector").withColumn("_i", F.explode(F.array(day * 2, F.floor(day / F.lit(width)).cast("int") * 2 + 1)))
    return wanted.join(sums, ["sector", "_i"], "left").groupBy("sector", "date").agg(F.try_divide(F.sum("_s"), F.sum("_k")).alias("peer_mom"))


def one_hot(df: DataFrame, column: str, vocabulary: Sequence[str], prefix: str) -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in vocabulary])


# ---- news flow -------------------------------------------------------------------------------------------------
def news_recency(events: DataFrame, news: DataFrame, t: str, nt: str, hours: int = 24, inclusive_start: bool = False) -> DataFrame:
    """Hours since the previous item and number of items in (t-h, t), or [t-h, t).

    The count is a difference of two running counts at distinct times, so no item is paired with
    the items around it.
    """
    per_time = news.groupBy("ticker", F.col(nt).alias("nt")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(per_time, ["ticker"], ["nt"], time_block("nt"), {"cum": F.col("_n")}).select("ticker", "nt", "cum")
    e = events.withColumn("_lo", F.timestamp_micros(micros(t) - F.lit(hours).cast("long") * HOUR))
    a = asof(e, cum, ["ticker"], t, "nt", ["cum"], exact=False, out="_a")
    z = asof(a, cum, ["ticker"], "_lo", "nt", ["cum"], exact=not inclusive_start, out="_z")
    return (
        z.withColumn("hours_since_prev", (micros(t) - micros("_a.nt")) / F.lit(float(HOUR)))
        .withColumn("items_prior", F.coalesce(F.col("_a.cum"), F.lit(0)) - F.coalesce(F.col("_z.cum"), F.lit(0)))
        .drop("_a", "_z", "_lo")
    )


def et_hour(t: str) -> Column:
    local = F.from_utc_timestamp(F.col(t), ET)
    return F.hour(local) + F.minute(local) / F.lit(60.0)


# ---- volatility and beta ------------------------------------------------------------------------------------------
def sigma_anchors(bars: DataFrame, horizon: int = P.HORIZON_BARS, warmup: int = P.SIGMA_WARMUP_BARS, step: int = P.SIGMA_STEP_BARS, min_anchors: int = 5) -> DataFrame:
    """Return over the next `horizon` bars from every `step`-th bar, keyed by its end; none if too few."""
    w = Window.partitionBy("ticker").orderBy("ts")
    rows = bars.select(
        "ticker", "ts", "close", (F.row_number().over(w) - 1).alias("_i"), F.lead("close", horizon).over(w).alias("_c"), F.lead("ts", horizon).over(w).alias("end_ts")
    )
    a = rows.filter((F.col("_i") >= warmup) & ((F.col("_i") - warmup) % step == 0) & F.col("end_ts").isNotNull())
    a = a.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).filter(F.col("_k") >= min_anchors)
    return a.select("ticker", "end_ts", (F.try_divide(F.col("_c"), F.col("close")) - 1).alias("ret"))


def trailing_sigma(events: DataFrame, anchors: DataFrame, t: str, min_anchors: int = P.SIGMA_MIN_ANCHORS, out: str = "sigma") -> DataFrame:
    """Sample deviation of all anchor returns that ended strictly before the event."""
    w = Window.partitionBy("ticker").orderBy("end_ts").rowsBetween(Window.unboundedPreceding, 0)
    run = anchors.select("ticker", "end_ts", F.stddev_samp("ret").over(w).alias("sd"), F.count("ret").over(w).alias("k"))
    j = asof(events, run, ["ticker"], t, "end_ts", ["sd", "k"], exact=False, block=DAY, out="_s")
    return j.withColumn(out, F.when(F.col("_s.k") >= min_anchors, F.col("_s.sd"))).drop("_s")


def typical_sigma(anchors: DataFrame, min_anchors: int = 20) -> DataFrame:
    return anchors.groupBy("ticker").agg(F.stddev_samp("ret").alias("sigma"), F.count(F.lit(1)).alias("n_anchors")).withColumn(
        "sigma", F.when(F.col("n_anchors") >= min_anchors, F.col("sigma"))
    )


def returns_with_bench(daily: DataFrame, bench: DataFrame) -> DataFrame:
    """Daily closes with own and benchmark simple returns on common dates.

    The benchmark, one row per day, is sent to the tickers' rows: these move once, by ticker, for all windows that follow.
    """
    b = bench.select("d", F.col("c").alias("bc"), (F.try_divide(F.col("c"), F.lag("c").over(Window.orderBy("d"))) - 1).alias("br"))
    own = daily.withColumn("r", F.try_divide(F.col("c"), F.lag("c").over(Window.partitionBy("ticker").orderBy("d"))) - 1)
    return own.join(F.broadcast(b), "d", "left")


def _with_moments(rets: DataFrame, newest: int, n: int) -> DataFrame:
    """Moments of the common-date returns over the `n` rows that end `newest` rows before each row.

    Each sum is the difference of two running sums, so the cost per row does not grow with `n`.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("r").isNotNull() & F.col("br").isNotNull()
    zero = F.lit(0.0)
    terms = {
        "k": F.when(both, 1.0).otherwise(zero),
        "x": F.when(both, F.col("br")).otherwise(zero),
        "y": F.when(both, F.col("r")).otherwise(zero),
        "xy": F.when(both, F.col("br") * F.col("r")).otherwise(zero),
        "xx": F.when(both, F.col("br") * F.col("br")).otherwise(zero),
        "kb": F.when(F.col("br").isNotNull(), 1.0).otherwise(zero),
        "b": F.coalesce(F.col("br"), zero),
        "bb": F.coalesce(F.col("br") * F.col("br"), zero),
    }
    rows = rets.select("*", F.row_number().over(w).alias("_n"), *[F.sum(t).over(run).alias(f"_c_{m}") for m, t in terms.items()])

    def at(m: str, back: int) -> Column:
        return F.coalesce(F.lag(f"_c_{m}", back).over(w), zero) if back else F.col(f"_c_{m}")

    rows = rows.select("*", *[(at(m, newest) - at(m, newest + n)).alias(f"_{m}") for m in terms])
    return rows.drop(*[f"_c_{m}" for m in terms])


def _cov_samp() -> Column:
    k = F.col("_k")
    return F.when(k > 1, (F.col("_xy") - F.col("_x") * F.col("_y") / F.when(k > 0, k)) / F.when(k > 1, k - 1))


def event_beta(rets: DataFrame, window: int = P.BETA_WINDOW, min_days: int = P.BETA_MIN_EVENT, keep: Sequence[str] = ()) -> DataFrame:
    """Beta over the last `window` bars up to each day: sample covariance over population variance.

    The window's first bar gives no return, so `window - 1` returns enter. Read it strictly before
    the anchor date. `keep` names further columns of `rets` to return.
    """
    rows = _with_moments(rets, 0, window - 1)
    k = F.when(F.col("_k") > 0, F.col("_k"))
    rows = rows.withColumn("_var", (F.col("_xx") - F.col("_x") * F.col("_x") / k) / k)
    ok = (F.col("_n") >= min_days) & (F.col("_k") >= min_days) & (F.col("_var") > 0)
    return rows.select(
        "ticker", "d", *keep, F.col("_k").cast("long").alias("beta_n"), F.when(ok, _cov_samp() / F.when(F.col("_var") > 0, F.col("_var"))).alias("beta")
    )


def rolling_beta(rets: DataFrame, window: int = P.BETA_WINDOW, min_days: int = P.BETA_MIN_ROLLING) -> DataFrame:
    """Beta over the `window` rows before each day: sample covariance over sample variance."""
    rows = _with_moments(rets, 1, window)
    k = F.col("_kb")
    var = (F.col("_bb") - F.col("_b") * F.col("_b") / F.when(k > 0, k)) / F.when(k > 1, k - 1)
    rows = rows.withColumn("_var", var)
    ok = (F.col("_k") >= min_days) & (k >= min_days) & (F.col("_var") > 0)
    return rows.select(*rets.columns, F.when(ok, _cov_samp() / F.when(F.col("_var") > 0, F.col("_var"))).alias("beta"))


def population_returns(daily: DataFrame, bench: DataFrame, horizons: Sequence[int] = P.STUDY_HORIZONS, gap_days: int = P.HALT_GAP_DAYS, window: int = P.BETA_WINDOW, min_days: int = P.BETA_MIN_ROLLING) -> DataFrame:
    """Every ticker-day's beta-adjusted forward returns; windows that cross a halt gap are null."""
    # Breaks up to each row: a window crosses one where the count grows on the way, so the cost per row does not grow with it.
    # Gaps, breaks and leads stand where a window over the same order runs anyway, and share it.
    w = Window.partitionBy("ticker").orderBy("d")
    gaps = daily.withColumn("_gap", F.datediff("d", F.lag("d").over(w)))
    rets = returns_with_bench(gaps, bench)
    breaks = F.count_if(F.col("_gap") > gap_days).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rolling_beta(rets.withColumn("_breaks", breaks), window, min_days)
    out = []
    for h in horizons:
        ret = F.try_divide(F.lead("c", h + 1).over(w), F.lead("c", 1).over(w)) - 1
        b = F.try_divide(F.lead("bc", h + 1).over(w), F.lead("bc", 1).over(w)) - 1
        out.append(F.when(F.lead("_breaks", h + 1).over(w) == F.col("_breaks"), ret - F.col("beta") * b).alias(f"adj_ret_{h}d"))
    return rows.select("ticker", "d", *out)


def average_dollar_volume(daily: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    d = daily
    if start is not None:
        d = d.filter(F.col("d") >= start)
    if end is not None:
        d = d.filter(F.col("d") <= end)
    return d.groupBy("ticker").agg(F.avg(F.col("c") * F.col("v")).alias("adv"))


# ---- frames and checks ------------------------------------------------------------------------------------------------
def align_columns(df: DataFrame, expected: Sequence[str], one_hot_prefixes: Sequence[str] = ("sect_", "nt_")) -> DataFrame:
    """Exactly the expected feature columns: absent numeric -> null, absent or null one-hot -> 0."""
    def column(c: str) -> Column:
        base = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        return (F.coalesce(base, F.lit(0.0)) if c.startswith(tuple(one_hot_prefixes)) else base).alias(c)

    return df.select(*[column(c) for c in expected])


def time_of_day(t0: str, sess_start: str, sess_end: str) -> Column:
    return (
        F.when(micros(t0) - micros(sess_start) < HOUR, "first hour")
        .when(micros(sess_end) - micros(t0) <= 2 * HOUR, "last 2h")
        .otherwise("midday")
    )


def leakage_checks(events: DataFrame, t: str, entry: str, exit_: str, delay_sec: str) -> DataFrame:
    """One row: ordering violations, overnight count and delay quantiles in minutes."""
    from tidemark.functions.scan import exact_quantiles

    def et_date(c):
        return F.to_date(F.from_utc_timestamp(F.col(c), ET))

    base = events.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(entry) < F.col(t)).alias("n_entry_before_news"),
        F.count_if(F.col(exit_) <= F.col(entry)).alias("n_exit_not_after_entry"), F.count_if(et_date(entry) != et_date(t)).alias("n_overnight"),
    )
    q = exact_quantiles(events.withColumn("_m", F.col(delay_sec) / F.lit(60.0)), [], "_m", {"median_delay_min": 0.5, "p95_delay_min": 0.95})
    return base.select(
        "*", q.select("median_delay_min").scalar().alias("median_delay_min"), q.select("p95_delay_min").scalar().alias("p95_delay_min")
    )


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "feature", "null_rate")
