"""Alignment of events to sessions, bars and outcomes: as-of, interval, range, semi and anti joins.

Bar tables hold one row per ticker and minute (hour, day), so a ticker's rows are bounded by the
clock: at most 525,600 minutes, 8,760 hours or 366 days a year. Windows over bars may therefore
partition by ticker. Events, news and signals have no such bound and only meet bars through
`functions.scan.asof` or equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.hashing import hash32
from tidemark.functions.scan import DAY, asof, first_per_key, micros, position, time_block

MINUTE = 60_000_000


def after(t: str | Column, minutes: int | Column) -> Column:
    """Timestamp `minutes` after `t`."""
    m = F.lit(minutes).cast("long") if isinstance(minutes, int) else minutes.cast("long")
    return F.timestamp_micros((micros(t) + m * MINUTE).cast("long"))


def seconds_between(a: str, b: str) -> Column:
    return (micros(b) - micros(a)) / F.lit(1e6)


# ---- sessions ------------------------------------------------------------------------------
def with_session(df: DataFrame, t: str, sessions: DataFrame, how: str = "left", columns: Sequence[str] = ()) -> DataFrame:
    """Session containing `t` (start inclusive, end exclusive), found by equi-join on the UTC date.

    A session is listed under each UTC date it touches, so the range condition is only a filter on
    a date match and the join never becomes a nested loop.
    """
    day = F.to_date(F.timestamp_micros(micros("sess_end") - 1))
    listed = sessions.select(
        F.explode(F.sequence(F.to_date("sess_start"), day)).alias("_sd"), "sess_start", "sess_end", *columns
    )
    cond = (F.to_date(df[t]) == listed["_sd"]) & (df[t] >= listed["sess_start"]) & (df[t] < listed["sess_end"])
    joined = df.join(listed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_sd")


def regular_bars(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars inside a session, one per ticker and timestamp, with their session bounds."""
    return with_session(bars, "ts", sessions, "inner")


def with_exit(bars: DataFrame, horizon: int = P.HORIZON_BARS) -> DataFrame:
    """Add bar number `idx` and the bar `horizon` rows later (sessions may be crossed)."""
    w = Window.partitionBy("ticker").orderBy("ts")
    return bars.select(
        "*",
        F.row_number().over(w).cast("long").alias("idx"),
        F.lead("ts", horizon).over(w).alias("exit_ts"),
        F.lead("close", horizon).over(w).alias("exit_price"),
    )


def entry_bar(events: DataFrame, bars: DataFrame, t: str, payload: Sequence[str], out: str = "bar") -> DataFrame:
    """First bar at or after the event."""
    return asof(events, bars, ["ticker"], t, "ts", payload, forward=True, out=out)


def anchor_entries(entries: DataFrame, t: str) -> DataFrame:
    """Anchor of the entry delay; needs the event's session (`sess_start`) and `bar.sess_start`.

    Inside a session the entry must fall in that session and the anchor is the event; outside, the
    anchor is the start of the session that holds the entry bar.
    """
    inside = F.col("sess_start").isNotNull()
    kept = entries.filter(F.col("bar").isNotNull() & (~inside | (F.col("bar.sess_start") == F.col("sess_start"))))
    return kept.withColumn("anchor_ts", F.when(inside, F.col(t)).otherwise(F.col("bar.sess_start")))


def delay_gate(anchored: DataFrame, max_delay_min: float = P.ENTRY_MAX_DELAY_MIN) -> DataFrame:
    delay = micros("bar.ts") - micros("anchor_ts")
    return anchored.withColumn("delay_sec", F.floor(delay / 1e6).cast("long")).filter(
        (delay >= 0) & (delay <= F.lit(int(max_delay_min * MINUTE)))
    )


def compute_events(
    news: DataFrame,
    bars: DataFrame,
    sessions: DataFrame,
    t: str = "published_utc",
    horizon: int = P.HORIZON_BARS,
    max_delay_min: float = P.ENTRY_MAX_DELAY_MIN,
) -> DataFrame:
    """News to labelled events: entry at the first regular bar, exit `horizon` bars later."""
    tradable = with_exit(regular_bars(bars, sessions), horizon)
    payload = ["ts", "idx", "open", "exit_ts", "exit_price", "sess_start", "sess_end"]
    entries = entry_bar(with_session(news, t, sessions), tradable, t, payload)
    gated = delay_gate(anchor_entries(entries, t), max_delay_min)
    done = gated.filter((F.col("bar.open") > 0) & (F.col("bar.exit_price") > 0))
    return done.select(
        *[c for c in news.columns],
        F.col("bar.ts").alias("entry_ts"),
        F.col("bar.idx").alias("entry_idx"),
        "delay_sec",
        F.col("bar.open").alias("entry_price"),
        F.col("bar.exit_ts").alias("exit_ts"),
        F.col("bar.exit_price").alias("exit_price"),
        (F.try_divide(F.col("bar.exit_price"), F.col("bar.open")) - 1).alias("fwd_ret"),
    )


def latency_grid(news: DataFrame, bars: DataFrame, sessions: DataFrame, delays: Sequence[int] = (0, 1, 4, 15, 43),
                 t: str = "published_utc", horizon: int = P.HORIZON_BARS) -> DataFrame:
    """Returns when the entry is taken `delay_min` later; exit stays `horizon` bars after the entry."""
    shifted = news.withColumn("delay_min", F.explode(F.array(*[F.lit(d) for d in delays])))
    shifted = shifted.withColumn("t_entry", after(t, F.col("delay_min")))
    tradable = with_exit(regular_bars(bars, sessions), horizon)
    e = entry_bar(shifted, tradable, "t_entry", ["ts", "open", "exit_ts", "exit_price"])
    return e.filter((F.col("bar.open") > 0) & (F.col("bar.exit_price") > 0)).withColumn(
        "fwd_ret", F.try_divide(F.col("bar.exit_price"), F.col("bar.open")) - 1
    )


# ---- returns over a wall-clock window ------------------------------------------------------------
def window_returns(windows: DataFrame, bars: DataFrame, t0: str = "t0", t1: str = "t1", out: str = "ret") -> DataFrame:
    """Open of the first bar at or after `t0` to close of the last bar before `t1`."""
    a = asof(windows, bars, ["ticker"], t0, "ts", ["ts", "open"], forward=True, out="_a")
    z = asof(a, bars, ["ticker"], t1, "ts", ["ts", "close"], exact=False, out="_z")
    ok = F.col("_z.ts") >= F.col("_a.ts")
    return z.withColumn(out, F.when(ok, F.try_divide(F.col("_z.close"), F.col("_a.open")) - 1)).drop("_a", "_z")


def universe_returns(windows: DataFrame, bars: DataFrame, universe: DataFrame, benchmark: str) -> DataFrame:
    """Return of every universe ticker over each distinct window (t0, t1), minus the benchmark's.

    The result is windows x universe by definition. The universe is a dimension table; it enters as
    one array that every window explodes, and the bars are then met by as-of joins per ticker.
    """
    names = universe.agg(F.sort_array(F.collect_set("ticker")).alias("a")).scalar()
    wide = windows.select("t0", "t1").distinct().withColumn("ticker", F.explode(names))
    rets = window_returns(wide, bars)
    bench = rets.filter(F.col("ticker") == benchmark).select("t0", "t1", F.col("ret").alias("bench_ret"))
    return rets.join(bench, ["t0", "t1"], "left").withColumn("adj", F.col("ret") - F.col("bench_ret"))


def clip_to_session(df: DataFrame, t0: str, sess_end: str, horizon_min: int = P.HORIZON_BARS) -> DataFrame:
    return df.withColumn("t1", F.least(after(t0, horizon_min), F.col(sess_end)))


# ---- daily event study ------------------------------------------------------------------------------
def daily_path(daily: DataFrame, gap_days: int = P.HALT_GAP_DAYS, horizons: Sequence[int] = ()) -> DataFrame:
    """Daily bars with row number, day gap, last row number and the row before the next halt gap.

    `horizons` adds `exits`: date and close of the exit of each horizon from the bar, in their order (see `study_exits`).
    """
    w = Window.partitionBy("ticker").orderBy("d")
    leads = [F.lead(F.struct("d", "c"), h).over(w) for h in horizons]
    rows = daily.select(
        "*",
        F.row_number().over(w).cast("long").alias("idx"),
        F.datediff("d", F.lag("d").over(w)).alias("gap"),
        F.datediff(F.lead("d").over(w), "d").alias("gap_next"),
        *([F.array(*leads).alias("exits")] if horizons else []),
    )
    # Backwards, the last row of a ticker comes first.
    back = Window.partitionBy("ticker").orderBy(F.col("d").desc(), F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("idx", "d", "c") if horizons else F.struct("idx")
    rows = rows.select("*", F.first(here).over(back).alias("_last"), F.min(F.when(F.col("gap_next") > gap_days, here)).over(back).alias("_halt"))
    rows = rows.withColumn("last_idx", F.col("_last.idx")).withColumn("halt_idx", F.col("_halt.idx"))
    if horizons:
        end, stop = F.struct("_last.d", "_last.c"), F.struct("_halt.d", "_halt.c")
        target = [F.col("idx") + h for h in horizons]
        cut = [F.when(t > F.col("halt_idx"), stop).when(t <= F.col("last_idx"), F.get("exits", F.lit(i))).otherwise(end) for i, t in enumerate(target)]
        rows = rows.withColumn("exits", F.array(*cut))
    return rows.drop("_halt", "_last")


def study_entries(events: DataFrame, path: DataFrame, anchor: str) -> DataFrame:
    """Entry is the first daily bar strictly after the anchor date. It brings along the `exits` and `before` of the path, if any."""
    payload = ["d", "idx", "c", "halt_idx", "last_idx", *[c for c in ("exits", "before") if c in path.columns]]
    e = asof(events, path, ["ticker"], anchor, "d", payload, forward=True, exact=False, block=None, out="entry")
    return e.filter(F.col("entry").isNotNull())


def study_exits(entries: DataFrame, path: DataFrame, horizons: Sequence[int] = P.STUDY_HORIZONS) -> DataFrame:
    """Exit `h` bars later, or at the last bar before a halt gap or the end of data (truncated).

    A path with `exits` of the same horizons brings them along with the entry; another one is met again by row number.
    """
    known = "exits" in path.columns
    numbers = F.posexplode(F.array(*[F.lit(h) for h in horizons]))
    long = entries.select("*", numbers.alias("_k", "h"))
    target = F.col("entry.idx") + F.col("h")
    hit_gap = F.coalesce(target > F.col("entry.halt_idx"), F.lit(False))
    long = long.withColumn("truncated", hit_gap | (target > F.col("entry.last_idx")))
    if known:
        x = F.get("entry.exits", F.col("_k"))
        met = long.withColumn("exit_date", x.getField("d")).withColumn("exit_price", x.getField("c"))
    else:
        long = long.withColumn("_xi", F.when(hit_gap, F.col("entry.halt_idx")).otherwise(F.least(target, F.col("entry.last_idx"))))
        exits = path.select("ticker", F.col("idx").alias("_xi"), F.col("d").alias("exit_date"), F.col("c").alias("exit_price"))
        met = long.join(exits, ["ticker", "_xi"])
    return (
        met.withColumn("ret", F.try_divide(F.col("exit_price"), F.col("entry.c")) - 1)
        .withColumn("entry_date", F.col("entry.d"))
        .withColumn("entry_price", F.col("entry.c"))
        .drop("_xi", "_k")
    )


def bench_between(df: DataFrame, bench: DataFrame, start: str, end: str, out: str = "bench_ret") -> DataFrame:
    """Benchmark return between two dates, inclusive; null unless it has two bars in between.

    The benchmark is one row per day: its first bar from each calendar day on and its last one up to each are two tables
    bounded by the clock, sent to the rows of `df`, which stay where they are.
    """
    w = Window.orderBy("d")
    numbered = bench.select("d", "c", F.row_number().over(w).alias("i")).filter(F.col("d").isNotNull())
    near = numbered.select("*", F.lag("d").over(w).alias("_p"), F.lead("d").over(w).alias("_n"))
    ends = numbered.agg(F.min("d").alias("a"), F.max("d").alias("z"))
    begin, last = F.coalesce(F.date_add("_p", 1), "d"), F.coalesce(F.date_add("_n", -1), "d")
    on = near.filter(begin <= F.col("d")).select(F.explode(F.sequence(begin, F.col("d"))).alias("_from"), F.struct("c", "i").alias("_a"))
    upto = near.filter(last >= F.col("d")).select(F.explode(F.sequence(F.col("d"), last)).alias("_to"), F.struct("c", "i").alias("_z"))
    # Before the first bar the first one is next, after the last one it is the latest.
    keyed = df.withColumn("_from", F.when(F.col(start).isNotNull(), F.greatest(F.col(start), ends.select("a").scalar())))
    keyed = keyed.withColumn("_to", F.when(F.col(end).isNotNull(), F.least(F.col(end), ends.select("z").scalar())))
    met = keyed.join(F.broadcast(on), "_from", "left").join(F.broadcast(upto), "_to", "left")
    value = F.when(F.col("_z.i") > F.col("_a.i"), F.try_divide(F.col("_z.c"), F.col("_a.c")) - 1)
    return met.withColumn(out, value).select(*df.columns, out)


def eligible_days(days: DataFrame, events: DataFrame, date: str, event_date: str, exclusion: int = P.EXCLUSION_DAYS) -> DataFrame:
    """Flag ticker-days with no event of that ticker within +/- `exclusion` days. Days that lie by ticker stay there."""
    marks = events.select("ticker", F.col(event_date).alias(date)).filter(F.col("ticker").isNotNull() & F.col(date).isNotNull())
    rows = days.filter(F.col("ticker").isNotNull() & F.col(date).isNotNull()).withColumn("_e", F.lit(0)).unionByName(
        marks.distinct().repartition("ticker").withColumn("_e", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy("ticker").orderBy(F.unix_date(date)).rangeBetween(-exclusion, exclusion)
    return rows.withColumn("eligible", F.max("_e").over(w) == 0).filter("_e = 0").drop("_e")


# ---- corporate actions -------------------------------------------------------------------------------
def suppressed_until(actions: DataFrame, sessions: DataFrame, n_sessions: int = P.CA_SUPPRESSION_SESSIONS) -> DataFrame:
    """Per ticker: start of the n-th session after the latest ex-date's session (clipped at the last)."""
    w = Window.orderBy("sess_start")
    cal = sessions.select("sess_start", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    spin = actions.filter(F.col("type") == "spin_off").select("ticker", F.to_timestamp("ex_date").alias("ex_ts")).distinct()
    hit = asof(spin, cal, [], "ex_ts", "sess_start", ["i", "n"], forward=True, block=None, out="s")
    last = cal.agg(F.max("n")).scalar()
    target = hit.select("ticker", F.least(F.coalesce(F.col("s.i") + n_sessions, last), last).alias("i"))
    return target.join(cal.select("i", "sess_start"), "i").groupBy("ticker").agg(F.max("sess_start").alias("until_ts"))


def suppress(signals: DataFrame, until: DataFrame, t: str = "ts_utc") -> DataFrame:
    joined = signals.join(until, "ticker", "left")
    return joined.withColumn("suppressed", F.coalesce(F.col(t) < F.col("until_ts"), F.lit(False)))


# ---- outcome bookkeeping ------------------------------------------------------------------------------
def pending_outcomes(signals: DataFrame, outcomes: DataFrame, older_than: Column) -> DataFrame:
    """Every signal, fired or silent, with no outcome and old enough."""
    return signals.filter(F.col("ts_utc") <= older_than).join(outcomes, "signal_id", "left_anti")


def upsert_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write per signal wins (`filled_at`, incoming before current on ties)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_per_key(both, ["signal_id"], [F.col("filled_at").desc(), F.col("_new").desc()]).drop("_new")


def placebo_points(events: DataFrame, bars: DataFrame, news: DataFrame, t: str, quiet_hours: int = 2,
                   per_event: int = 3, seed: str = "placebo", spare: int = 1) -> DataFrame:
    """Up to `per_event` quiet bars per event: same ticker, same ET hour, no news within the window.

    Candidates are ranked by hash inside (ticker, hour) once. The j-th event of a (ticker, hour) takes
    ranks (j-1)*k+1..j*k modulo the number of candidates, so no event meets every candidate. Where an
    hour has no candidate, the same is done over all hours of the ticker.
    """
    lim = quiet_hours * 3600 * 1_000_000
    times = news.select("ticker", F.col(t).alias("nt")).distinct()
    prev = asof(bars.select("ticker", "ts"), times, ["ticker"], "ts", "nt", [], out="p")
    both = asof(prev, times, ["ticker"], "ts", "nt", [], forward=True, out="q")
    quiet = both.filter(
        F.coalesce(micros("ts") - micros("p.nt") > lim, F.lit(True)) & F.coalesce(micros("q.nt") - micros("ts") > lim, F.lit(True))
    ).select("ticker", "ts", F.hour(F.from_utc_timestamp("ts", "America/New_York")).alias("hr"))
    quiet = quiet.withColumn("_h", hash32(F.lit(seed), "ticker", F.unix_micros("ts")))
    hour_rank = Window.partitionBy("ticker", "hr").orderBy("_h", "ts")
    any_rank = Window.partitionBy("ticker").orderBy("_h", "ts")
    pool = quiet.select(
        "ticker", "hr", "ts",
        F.row_number().over(hour_rank).alias("rh"), F.row_number().over(any_rank).alias("ra"),
    )
    nh = pool.groupBy("ticker", "hr").agg(F.count(F.lit(1)).alias("nh"))
    na = pool.groupBy("ticker").agg(F.count(F.lit(1)).alias("na"))
    ev = events.withColumn("hr", F.hour(F.from_utc_timestamp(t, "America/New_York")))
    numbered = position(ev, ["ticker", "hr"], [t, "news_id"], time_block(t, DAY), "j")
    drawn = (
        numbered.join(nh, ["ticker", "hr"], "left")
        .join(na, ["ticker"])
        .withColumn("matched_hour", F.col("nh").isNotNull())
        .withColumn("pool_n", F.coalesce("nh", "na"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_event), F.col("pool_n").cast("int")))))
        .withColumn("r", F.pmod((F.col("j") - 1) * per_event + F.col("k") - 1, F.col("pool_n")) + 1)
    )
    by_hour = drawn.filter("matched_hour").join(
        pool.select("ticker", "hr", F.col("rh").alias("r"), F.col("ts").alias("placebo_ts")), ["ticker", "hr", "r"]
    )
    by_any = drawn.filter("NOT matched_hour").join(
        pool.select("ticker", F.col("ra").alias("r"), F.col("ts").alias("placebo_ts")), ["ticker", "r"]
    )
    cols = ["news_id", "ticker", t, "k", "matched_hour", "placebo_ts"]
    return by_hour.select(*cols).unionByName(by_any.select(*cols))


def exit_margin(events: DataFrame, bars: DataFrame, exit_ts: str = "exit_ts") -> DataFrame:
    """Hours between an event's exit and its ticker's last bar, banded."""
    last = bars.groupBy("ticker").agg(F.max("ts").alias("last_bar"))
    h = (micros("last_bar") - micros(exit_ts)) / F.lit(3.6e9)
    band = (
        F.when(h <= 0, "unresolved").when(h <= 24, "<1d").when(h <= 72, "1-3d").when(h <= 168, "3-7d").otherwise(">7d")
    )
    return events.join(last, "ticker").withColumn("margin_hours", h).withColumn("margin_band", band)


def entry_price_with_fallback(signals: DataFrame, bars: DataFrame, live: str, t: str) -> DataFrame:
    """Live price when positive, else the last close at or before `t`, with the source named."""
    j = asof(signals, bars, ["ticker"], t, "ts", ["close"], out="lastbar")
    ok = F.coalesce(F.col(live) > 0, F.lit(False))
    return (
        j.withColumn("entry_price", F.when(ok, F.col(live)).otherwise(F.col("lastbar.close")))
        .withColumn("entry_source", F.when(ok, "live_trade").otherwise("last_regular_close_proxy"))
        .filter(F.col("entry_price").isNotNull())
        .drop("lastbar")
    )
