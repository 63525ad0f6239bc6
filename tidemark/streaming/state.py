"""Feature state that arriving bars move forward, so that a live batch reads a bounded history.

Bars are kept by day. A day that is over is folded into one row per ticker (`carry`): the running means of the hourly
indicators and the last hours they look back on, daily closes as far as the regime looks back, open return anchors and the
sums of the closed ones. The features of an item of day D need the carry of the last day folded before D and the bars since
then: one day's bars and one row per ticker, however long the run. All is DataFrame work; every table has a partition per
day, and one per batch inside it where a batch can be replayed, so a replay overwrites its own rows.

Bars of a day must arrive before the first item (or `roll`) of a later day folds it; bars that come later are kept, and
`rebuild` folds from their day on again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.scan import HOUR, micros
from tidemark.operators import features as E
from tidemark.operators import frame as R

BARS = "ticker string, ts timestamp, open double, high double, low double, close double, volume long"
TAIL = P.BB_PERIOD  # hours that the indicators look back on
CLOSES = P.VOL_LONG_DAYS + 2  # days that the regime looks back on
_HOUR = "struct<ts:timestamp,high:double,low:double,close:double>"
_LAST = "struct<hour_end:timestamp,n:bigint,rsi:double,macd_hist:double,bb_pctb:double,bb_width:double,atr_pct:double>"
CARRY = (
    f"ticker string, n long, tail array<{_HOUR}>, eu double, ed double, f double, s double, g double, last {_LAST}, closes array<double>, n_days long, "
    "rv_short double, vol_ratio double, mom double, mom6 double, bars long, open array<struct<i:bigint,close:double>>, k long, s1 double, s2 double, last_end timestamp"
)


def write_day(df: DataFrame, path: str, day: str, batch_id: int) -> None:
    """Write a batch's rows by the day of a column; only the (day, batch) partitions that it holds are overwritten."""
    df.withColumn("day", F.to_date(day)).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def days_of(spark: SparkSession, path: str) -> list[dt.date]:
    """Days that a day-partitioned table holds, ascending; one folder name each."""
    return [dt.date.fromisoformat(n[4:]) for n in children(spark, path) if n.startswith("day=") and n[4:5].isdigit()]


def read_days(spark: SparkSession, path: str, schema: str, first: dt.date | None, last: dt.date | None, before: int | None = None) -> DataFrame:
    """Rows of the days first..last (either may be open) that batches before `before` wrote. Other days' folders are not listed."""
    picked = [d for d in days_of(spark, path) if (first is None or d >= first) and (last is None or d <= last)]
    if not picked:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, day date, batch_id int").option("basePath", path).parquet(*[f"{path}/day={d}" for d in picked])
    return (rows if before is None else rows.filter(F.col("batch_id") < before)).drop("day", "batch_id")


# ---- folding ------------------------------------------------------------------------------------------------
def advance_hours(carry: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hourly bars after the carried ones with their indicators and running means; carried hours are flagged `old`.

    The last carried hour holds the running means as their own first values, from which `features.ema` goes on.
    """
    tail = carry.select("ticker", F.col("n").alias("_n0"), F.size("tail").alias("_size"), "eu", "ed", "f", "s", "g", F.posexplode("tail").alias("_p", "_h"))
    seed = F.col("_p") == F.col("_size") - 1
    old = tail.select("ticker", "_h.*", F.lit(True).alias("old"), "_n0", *[F.when(seed, F.col(c)).alias(f"_{c}") for c in ("eu", "ed", "f", "s", "g")])
    none = [F.lit(None).cast("double").alias(f"_{c}") for c in ("eu", "ed", "f", "s", "g")]
    new = hourly.select("ticker", "ts", "high", "low", "close", F.lit(False).alias("old"), F.lit(None).cast("long").alias("_n0"), *none)
    rows = old.unionByName(new)
    w = Window.partitionBy("ticker").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prev, fresh = F.lag("close").over(w), ~F.col("old")
    move = F.coalesce(F.col("close") - prev, F.lit(0.0))
    rows = rows.select(
        "*", (F.coalesce(F.max("_n0").over(Window.partitionBy("ticker")), F.lit(0)) + F.sum(fresh.cast("int")).over(upto)).alias("n"),
        F.when(fresh, F.greatest(move, F.lit(0.0))).otherwise(F.col("_eu")).alias("_up"), F.when(fresh, F.greatest(-move, F.lit(0.0))).otherwise(F.col("_ed")).alias("_dn"),
        F.when(fresh, F.col("close")).otherwise(F.col("_f")).alias("_fast"), F.when(fresh, F.col("close")).otherwise(F.col("_s")).alias("_slow"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)).alias("_tr"),
    ).drop("_eu", "_ed", "_f", "_s", "_n0")
    for value, alpha, out in (("_up", 1.0 / P.RSI_PERIOD, "eu"), ("_dn", 1.0 / P.RSI_PERIOD, "ed"), ("_fast", 2.0 / (P.MACD_FAST + 1), "f"), ("_slow", 2.0 / (P.MACD_SLOW + 1), "s")):
        rows = E.ema(rows, value, alpha, out)
    line = F.when(F.col("n") >= P.MACD_SLOW, F.col("f") - F.col("s"))
    rows = E.ema(rows.withColumn("_m", F.when(F.col("old"), F.col("_g")).otherwise(line)), "_m", 2.0 / (P.MACD_SIGNAL + 1), "g")
    rsi = F.when(F.col("ed") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("eu") / F.when(F.col("ed") != 0, F.col("ed"))))
    rows = rows.withColumn("rsi", F.when(F.col("n") >= P.RSI_PERIOD, rsi))
    rows = rows.withColumn("macd_hist", F.when(F.col("n") >= P.MACD_SLOW + P.MACD_SIGNAL - 1, F.try_divide(F.col("_m") - F.col("g"), F.col("close"))))
    tr = w.rowsBetween(1 - P.ATR_PERIOD, 0)
    rows = E.bollinger(rows).withColumn("atr_pct", F.when(F.count("_tr").over(tr) >= P.ATR_PERIOD, F.try_divide(F.avg("_tr").over(tr), F.col("close"))))
    return rows.withColumn("hour_end", F.timestamp_micros(micros("ts") + HOUR)).drop("_up", "_dn", "_fast", "_slow", "_tr", "_m", "_g")


def advance_anchors(carry: DataFrame, bars: DataFrame, horizon: int = P.HORIZON_BARS, warmup: int = P.SIGMA_WARMUP_BARS, step: int = P.SIGMA_STEP_BARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors closed by these bars: ticker, end_ts, ret; anchors still open: ticker, i, close; bars counted per ticker)."""
    w = Window.partitionBy("ticker").orderBy("ts")
    known = carry.select("ticker", F.col("bars").alias("_c"))
    rows = bars.select("ticker", "ts", "close", F.row_number().over(w).alias("_r")).join(known, "ticker", "left")
    rows = rows.select("ticker", "ts", "close", (F.coalesce("_c", F.lit(0)) + F.col("_r") - 1).cast("long").alias("i"))
    started = rows.filter((F.col("i") >= warmup) & ((F.col("i") - warmup) % step == 0)).select("ticker", "i", "close")
    anchors = carry.select("ticker", F.inline("open")).unionByName(started).withColumn("_end", F.col("i") + horizon)
    ends = rows.select("ticker", F.col("i").alias("_end"), F.col("ts").alias("end_ts"), F.col("close").alias("_x"))
    met = anchors.join(ends, ["ticker", "_end"], "left")
    closed = met.filter("end_ts IS NOT NULL").select("ticker", "end_ts", (F.try_divide(F.col("_x"), F.col("close")) - 1).alias("ret"))
    return closed, met.filter("end_ts IS NULL").select("ticker", "i", "close"), rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("_new"))


def _deviation(values: Column) -> Column:
    """Sample standard deviation of an array without nulls."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def fold(carry: DataFrame, bars: DataFrame) -> DataFrame:
    """The carry after these bars: one row per ticker ever seen. `bars` are whole days after the carried ones."""
    hours = advance_hours(carry, E.hourly_bars(bars))
    at = F.struct("ts", "high", "low", "close")
    last = F.struct("hour_end", "n", *E.INDICATORS)
    of_hours = hours.groupBy("ticker").agg(
        F.max("n").alias("n"), _last(F.sort_array(F.collect_list(at)), TAIL).alias("tail"), *[F.max_by(c, "ts").alias(c) for c in ("eu", "ed", "f", "s", "g")],
        F.max_by(F.when(~F.col("old"), last), F.when(~F.col("old"), F.col("ts"))).alias("_last"),
    )
    days = E.daily_closes(bars).groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda x: x.c).alias("_new_closes"))
    closed, still, counted = advance_anchors(carry, bars)
    sums = closed.groupBy("ticker").agg(F.count("ret").alias("_k"), F.sum("ret").alias("_s1"), F.sum(F.col("ret") * F.col("ret")).alias("_s2"), F.max("end_ts").alias("_end"))
    kept = still.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("i", "close"))).alias("open"))
    before = carry.select("ticker", "last", "closes", "n_days", "bars", "k", "s1", "s2", "last_end")
    rows = of_hours.join(before, "ticker", "left").join(days, "ticker", "left").join(counted, "ticker", "left").join(sums, "ticker", "left").join(kept, "ticker", "left")
    fresh = F.coalesce("_new_closes", F.array().cast("array<double>"))
    rows = rows.withColumn("closes", _last(F.concat(F.coalesce("closes", F.array().cast("array<double>")), fresh), CLOSES)).withColumn("n_days", (F.coalesce("n_days", F.lit(0)) + F.size(fresh)).cast("long"))
    c = F.col("closes")
    newest, sixth = F.try_element_at(c, F.lit(-1)), F.try_element_at(c, F.lit(-6))
    mom = F.try_divide(newest, sixth) - 1
    logs = F.filter(F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.ln(F.try_divide(b, a))), lambda x: x.isNotNull())
    short, long = _deviation(_last(logs, P.VOL_SHORT_DAYS)), _deviation(_last(logs, P.VOL_LONG_DAYS))
    rows = rows.withColumn("_short", short).withColumn("_long", long)
    ok = (F.col("n_days") >= P.VOL_LONG_DAYS + 2) & (F.col("_short") >= 0) & (F.col("_long") > 0)
    zero = F.lit(0.0)
    return rows.select(
        "ticker", F.col("n").cast("long").alias("n"), "tail", "eu", "ed", "f", "s", "g", F.coalesce("_last", "last").cast(_LAST).alias("last"), "closes", "n_days",
        F.when(ok, F.col("_short")).alias("rv_short"), F.when(ok, F.try_divide(F.col("_short"), F.col("_long"))).alias("vol_ratio"), F.when(ok, mom).alias("mom"), F.when(F.col("n_days") >= 6, mom).alias("mom6"),
        (F.coalesce("bars", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("long").alias("bars"), F.coalesce("open", F.array().cast("array<struct<i:bigint,close:double>>")).alias("open"),
        (F.coalesce("k", F.lit(0)) + F.coalesce("_k", F.lit(0))).cast("long").alias("k"), (F.coalesce("s1", zero) + F.coalesce("_s1", zero)).alias("s1"), (F.coalesce("s2", zero) + F.coalesce("_s2", zero)).alias("s2"),
        F.coalesce("_end", "last_end").alias("last_end"),
    )


# ---- the state ----------------------------------------------------------------------------------------------
@dataclass
class FeatureState:
    """Bars by day and the carries of folded days under `root`, and the feature frame they give."""

    spark: SparkSession
    root: str
    sessions: DataFrame
    bench: DataFrame
    universe: DataFrame
    expected: Sequence[str]
    min_bars: int = P.MIN_HOURLY_BARS
    min_anchors: int = P.SIGMA_MIN_ANCHORS

    def add_bars(self, bars: DataFrame, batch_id: int) -> None:
        """Keep a batch of bars; one row per ticker and minute over all batches. A replay changes nothing."""
        write_day(bars.select(*[c.split()[0] for c in BARS.split(", ")]), f"{self.root}/bars", "ts", batch_id)

    def bars(self, first: dt.date | None, last: dt.date | None) -> DataFrame:
        return read_days(self.spark, f"{self.root}/bars", BARS, first, last)

    def carried(self, before: dt.date) -> tuple[dt.date | None, DataFrame]:
        """The last folded day before a day, and its carry."""
        days = [d for d in days_of(self.spark, f"{self.root}/carry") if d < before]
        if not days:
            return None, self.spark.createDataFrame([], CARRY)
        return days[-1], self.spark.read.schema(CARRY).parquet(f"{self.root}/carry/day={days[-1]}")

    def roll(self, day: dt.date) -> None:
        """Fold all bars up to and including a day that is over. Folding it again writes the same rows."""
        done, carry = self.carried(day + dt.timedelta(days=1))
        held = [d for d in days_of(self.spark, f"{self.root}/bars") if (done is None or d > done) and d <= day]
        if held:
            fold(carry, self.bars(held[0], held[-1])).write.mode("overwrite").parquet(f"{self.root}/carry/day={held[-1]}")

    def rebuild(self, day: dt.date) -> None:
        """Fold again from a day on whose bars have changed, one day after the other."""
        for d in [d for d in days_of(self.spark, f"{self.root}/carry") if d >= day]:
            done, carry = self.carried(d)
            fold(carry, self.bars(done + dt.timedelta(days=1) if done else None, d)).write.mode("overwrite").parquet(f"{self.root}/carry/day={d}")

    def frame(self, items: DataFrame, day: dt.date, flow: DataFrame, key: str = "news_hash", t: str = "published_utc") -> DataFrame:
        """Features of items published on `day`; `flow` has their recency. Days before it are folded first."""
        self.roll(day - dt.timedelta(days=1))
        done, carry = self.carried(day)
        bars = self.bars(done + dt.timedelta(days=1) if done else None, day)
        points = items.select(key, "ticker", t)

        def newest(marks: DataFrame, mt: str, columns: Sequence[str]) -> DataFrame:
            met = points.join(marks, "ticker").filter(F.col(mt) < F.col(t))
            return met.groupBy(key).agg(F.max_by(F.struct(*columns), mt).alias("_m")).select(key, "_m.*")

        hours = advance_hours(carry, E.hourly_bars(bars)).filter("NOT old").select("ticker", "hour_end", "n", *E.INDICATORS)
        ended = hours.unionByName(carry.filter("last IS NOT NULL").select("ticker", "last.*")).filter(F.col("n") >= self.min_bars)
        # A day has at most 25 such rows a ticker, and 49 return anchors: the newest one before the item by a plain join.
        tech = newest(ended, "hour_end", E.INDICATORS)
        # A session may have begun on the day before.
        vwap = E.session_vwap(points, self.bars(day - dt.timedelta(days=1), day), self.sessions, t).select(key, "dist_from_vwap")
        own = points.join(carry.select("ticker", *R.REGIME), "ticker", "left").select(key, *R.REGIME)
        sectors = carry.select("ticker", "mom6").join(self.universe, "ticker").groupBy("sector").agg(F.avg("mom6").alias("peer_mom"))
        peer = points.join(self.universe.select("ticker", "sector"), "ticker", "left").join(sectors, "sector", "left").select(key, "peer_mom")
        closed, _, _ = advance_anchors(carry, bars)
        run = Window.partitionBy("ticker").orderBy("end_ts").rowsBetween(Window.unboundedPreceding, 0)
        steps = carry.filter("k > 0").select("ticker", F.col("last_end").alias("end_ts"), F.col("k").alias("_k"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2")).unionByName(
            closed.select("ticker", "end_ts", F.count("ret").over(Window.partitionBy("ticker", "end_ts")).alias("_k"), F.col("ret").alias("_s1"), (F.col("ret") * F.col("ret")).alias("_s2"))
        )
        sums = steps.select("ticker", "end_ts", *[F.sum(c).over(run).alias(c[1:]) for c in ("_k", "_s1", "_s2")])
        spread = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("k"), F.lit(0.0)) / (F.col("k") - 1))
        sigma = points.select(key).join(newest(sums, "end_ts", ["k", "s1", "s2"]), key, "left").select(key, F.when(F.col("k") >= self.min_anchors, spread).alias("sigma"))
        return R.assemble(items, key, t, [tech, vwap, R.benchmark_part(points, key, t, self.bench), own, peer, flow.select(key, "hours_since_prev", "items_prior"), sigma], self.universe, self.expected)


# ---- what was seen ------------------------------------------------------------------------------------------------
@dataclass
class ItemState:
    """Items seen so far, kept so that a batch reads the days it touches.

    A hash holds the publishing time, so a second sighting falls on the same publishing day: only that day's hashes are
    read. Arrivals are kept by arrival day, with one row per ticker for the last arrival before a day, which is what
    recency needs beyond its window.
    """

    spark: SparkSession
    root: str

    HASHES = "news_hash string"
    ARRIVALS = "ticker string, nt timestamp"

    def unseen(self, items: DataFrame, batch_id: int, published: str = "published_utc") -> DataFrame:
        """Items whose hash no earlier batch has seen."""
        days = [r.d for r in items.select(F.to_date(published).alias("d")).distinct().collect() if r.d is not None]
        held = set(days_of(self.spark, f"{self.root}/hashes"))
        picked = [d for d in days if d in held]
        if not picked:
            return items
        path = f"{self.root}/hashes"
        known = self.spark.read.schema(f"{self.HASHES}, day date, batch_id int").option("basePath", path).parquet(*[f"{path}/day={d}" for d in picked])
        return items.join(known.filter(F.col("batch_id") < batch_id).select("news_hash"), "news_hash", "left_anti")

    def add(self, items: DataFrame, batch_id: int, published: str = "published_utc", arrival: str = "arrival") -> None:
        write_day(items.select("news_hash", F.col(published).alias("_p")), f"{self.root}/hashes", "_p", batch_id)
        self.add_arrivals(items.select("ticker", F.col(arrival).alias("nt")), batch_id)

    def add_arrivals(self, arrivals: DataFrame, batch_id: int) -> None:
        write_day(arrivals, f"{self.root}/arrivals", "nt", batch_id)
        # Arrivals of days that a snapshot has closed (none where time runs forward) are kept beside the snapshots.
        closed = days_of(self.spark, f"{self.root}/last")
        if closed:
            write_day(arrivals.filter(F.to_date("nt") < F.lit(closed[-1])), f"{self.root}/late", "nt", batch_id)

    def last_before(self, day: dt.date, batch_id: int) -> DataFrame:
        """Last arrival per ticker on days before `day`: a written snapshot, a row per ticker, made from the one before it
        and the days since; and what came late for it."""
        at, end = f"{self.root}/last", day - dt.timedelta(days=1)
        base = [d for d in days_of(self.spark, at) if d <= day]
        if not base or base[-1] < day:
            since = read_days(self.spark, f"{self.root}/arrivals", self.ARRIVALS, base[-1] if base else None, end, batch_id)
            old = self.spark.read.schema(self.ARRIVALS).parquet(f"{at}/day={base[-1]}") if base else self.spark.createDataFrame([], self.ARRIVALS)
            old.unionByName(since).groupBy("ticker").agg(F.max("nt").alias("nt")).write.mode("overwrite").parquet(f"{at}/day={day}")
        kept = self.spark.read.schema(self.ARRIVALS).parquet(f"{at}/day={day}")
        return kept.unionByName(read_days(self.spark, f"{self.root}/late", self.ARRIVALS, None, end, batch_id)).groupBy("ticker").agg(F.max("nt").alias("nt"))

    def recency(self, points: DataFrame, fresh: DataFrame, batch_id: int, t: str, hours: int = 24) -> DataFrame:
        """`features.news_recency` of points against all arrivals of earlier batches and `fresh` (ticker, nt).

        Read are the days from the first point's window on, and one row per ticker before them.
        """
        first = points.agg(F.min(F.to_date(t)).alias("d")).first().d
        if first is None:
            return E.news_recency(points, fresh, t, "nt", hours, inclusive_start=True)
        start = first - dt.timedelta(days=-(-hours // 24))
        seen = read_days(self.spark, f"{self.root}/arrivals", self.ARRIVALS, start, None, batch_id).unionByName(self.last_before(start, batch_id)).unionByName(fresh.select("ticker", "nt"))
        return E.news_recency(points, seen, t, "nt", hours, inclusive_start=True)
