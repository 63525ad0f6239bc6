"""The same operators over arriving items, with Structured Streaming.

No step relies on a watermark to forget: what must be remembered (items ever seen, counts so far) is a
written table that `foreachBatch` reads, so late and out-of-order files change nothing. Sinks write one
partition per batch id; a replayed batch overwrites its own output and sees only what earlier batches
wrote, so nothing is lost or doubled when executors or the driver are lost.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import align as A
from tidemark.operators import clean as C
from tidemark.operators import features as E
from tidemark.operators import frame as R
from tidemark.operators import labels as L
from tidemark.operators import outcomes as O
from tidemark.operators import text as X
from tidemark.session import checkpoint_dir
from tidemark.sources.tables import write_batch
from tidemark.streaming.state import BARS, FeatureState, ItemState, children, days_of, read_days, write_day


def item_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", pattern: str = "*", files_per_batch: int = 100) -> DataFrame:
    """Items landing as files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).format(fmt).load(folder)


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    """Whether the path (a folder, if asked) is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and (not folder or fs.getFileStatus(p).isDirectory())


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A table of the folder as a stream, whether it is one file or a folder of part files."""
    path = f"{folder}/{name}.{fmt}"
    if exists(spark, path, folder=True):
        return item_stream(spark, path, schema, fmt, f"*.{fmt}", files_per_batch)
    return item_stream(spark, folder, schema, fmt, f"{name}.{fmt}", files_per_batch)


def read_batches(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """What batches have written (only those before a batch id, if given); empty before the first."""
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch_id int")
    rows = spark.read.schema(f"{schema}, batch_id int").parquet(f"{root}/{name}")
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def ddl(df: DataFrame) -> str:
    """The schema of a frame as a string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Several feeds through one path, tagged with their name."""
    out = None
    for name, df in feeds.items():
        tagged = df.withColumn("news_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def once_only(items: DataFrame, t: str, key: str = "news_hash", memory: str = "2 days") -> DataFrame:
    """First sighting of each key while it is within the watermark; `first_sightings` never forgets."""
    return items.withWatermark(t, memory).dropDuplicatesWithinWatermark([key])


def earliest(batch: DataFrame, arrival: str, key: str = "news_hash") -> DataFrame:
    """One row per key, that of the earliest arrival (ties: the smallest row)."""
    return batch.groupBy(key).agg(F.min(F.struct(arrival, *[c for c in batch.columns if c not in (arrival, key)])).alias("_r")).select(key, "_r.*").select(*batch.columns)


def first_sightings(items: DataFrame, root: str, name: str, arrival: str, key: str = "news_hash") -> DataFrame:
    """First sighting of each key ever: a batch's own earliest rows, without keys that earlier batches have seen."""
    spark, schema = items.sparkSession, ddl(items)

    def step(df: DataFrame, batch_id: int) -> None:
        seen = read_batches(spark, root, name, schema, batch_id).select(key)
        write_batch(earliest(df, arrival, key).join(seen, key, "left_anti").select(*df.columns), root, name, batch_id)

    _run(items, root, name, step)
    return read_batches(spark, root, name, schema).drop("batch_id")


def start(stream: DataFrame, root: str, name: str, step, every: str | None = None):
    """Start `step` on each batch: all that has arrived, or with `every` (such as '120 seconds') one batch a period until
    the returned query is stopped."""
    writer = stream.writeStream.option("checkpointLocation", f"{root}/_progress/{name}").foreachBatch(step)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _run(stream: DataFrame, root: str, name: str, step) -> None:
    start(stream, root, name, step).awaitTermination()


def with_lag(items: DataFrame, published: str, arrival: str, max_minutes: int = P.MAX_RETRIEVAL_LAG_MIN) -> DataFrame:
    """Retrieval lag and the late flag. Not a watermark: late items are recorded, not dropped."""
    lag = (F.unix_micros(arrival) - F.unix_micros(published)) / F.lit(6e7)
    return items.withColumn("lag_minutes", lag).withColumn("rejected_stale", (lag > max_minutes).cast("int"))


def enrich(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """Stateless columns: relevance tier (stream-static join) and news type."""
    return X.relevance_tier(items, patterns).withColumn("news_type", X.news_type("headline", "summary"))


def story_counts(items: DataFrame, t: str, minutes: int = P.STORY_MINUTES) -> DataFrame:
    """Items per ticker and tumbling story window."""
    return items.groupBy("ticker", F.window(t, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("ticker", F.col("w.start").alias("bucket"), "n")


def failure_counts(failures: DataFrame, t: str, cycle: str = "120 seconds") -> DataFrame:
    """Poll failures per ticker and cycle."""
    return failures.groupBy("ticker", F.window(t, cycle).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("ticker", F.col("w.start").alias("cycle_start"), "n")


def poll_log(polls: DataFrame, t: str, cycle: str = "120 seconds") -> DataFrame:
    """Polls of a batch per ticker and cycle: `n`, and of them `n_failed` (those with an error)."""
    by = polls.groupBy("ticker", F.window(t, cycle).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_failed"), F.min(t).alias("first_utc"), F.max(t).alias("last_utc")).select("ticker", F.col("w.start").alias("cycle_start"), "n", "n_failed", "first_utc", "last_utc")


def polls_run(polls: DataFrame, root: str, name: str, t: str, cycle: str = "120 seconds") -> tuple[DataFrame, DataFrame]:
    """(poll counts per ticker and cycle, failure log) of a stream of polls with ticker, `t` and `error` (null if it
    went well). Each batch writes its own rows, which are summed on reading: late polls count in their own cycle."""
    spark = polls.sparkSession
    logged = polls.filter("error IS NOT NULL").select(F.col(t).alias("ts_utc"), "ticker", "error")
    counts = poll_log(polls, t, cycle)

    def step(df: DataFrame, batch_id: int) -> None:
        write_batch(df.filter("error IS NOT NULL").select(F.col(t).alias("ts_utc"), "ticker", "error"), root, f"{name}_failures", batch_id)
        write_batch(poll_log(df, t, cycle), root, name, batch_id)

    _run(polls, root, name, step)
    rows = read_batches(spark, root, name, ddl(counts)).groupBy("ticker", "cycle_start")
    merged = rows.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"), F.min("first_utc").alias("first_utc"), F.max("last_utc").alias("last_utc"))
    return merged, read_batches(spark, root, f"{name}_failures", ddl(logged)).drop("batch_id")


def expected_cycles(sessions: DataFrame, cycle_seconds: int = 120) -> DataFrame:
    """Start of every cycle that a session holds whole; bounded by the clock."""
    step = F.lit(cycle_seconds).cast("long")
    lo = F.ceil(F.unix_seconds("sess_start") / step).cast("long")
    hi = F.floor(F.unix_seconds("sess_end") / step).cast("long") - 1
    return sessions.filter(hi >= lo).select(F.explode(F.sequence(lo, hi)).alias("_c")).distinct().select(F.timestamp_seconds(F.col("_c") * step).alias("cycle_start"))


def cycle_coverage(counts: DataFrame, cycles: DataFrame, tickers: DataFrame) -> DataFrame:
    """Per ticker: expected cycles, those polled, those where every poll failed, the missing ones and their share.

    Missing is what is expected and has no poll. Counted from the polled cycles, so that the grid of tickers and cycles
    is never made; `missing_cycles` lists it for those that want rows.
    """
    total = cycles.agg(F.count(F.lit(1))).scalar()
    polled = counts.join(cycles, "cycle_start", "left_semi").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_polled"), F.count_if(F.col("n") == F.col("n_failed")).alias("n_failed_cycles"), F.sum("n_failed").alias("n_failures")
    )
    rows = tickers.select("ticker").distinct().withColumn("n_expected", total).join(polled, "ticker", "left").fillna(0, ["n_polled", "n_failed_cycles", "n_failures"])
    missing = F.col("n_expected") - F.col("n_polled")
    return rows.withColumn("n_missing", missing).withColumn("missing_share", F.try_divide(missing.cast("double"), F.col("n_expected").cast("double")))


def missing_cycles(counts: DataFrame, cycles: DataFrame, tickers: DataFrame) -> DataFrame:
    """Gaps per ticker: runs of expected cycles without a poll, as first and last missing cycle and their number.

    Polled cycles are numbered among the expected ones; a gap is a jump in these numbers, so only polled cycles are
    scanned, one row per ticker and cycle at most.
    """
    numbered = cycles.withColumn("i", F.row_number().over(Window.orderBy("cycle_start")))
    total = cycles.agg(F.count(F.lit(1)).cast("int")).scalar()
    names = tickers.select("ticker").distinct()
    ends = names.select("ticker", F.explode(F.array(F.lit(0), total + F.lit(1))).alias("i"))
    polled = counts.join(names, "ticker", "left_semi").join(numbered, "cycle_start").select("ticker", "i").unionByName(ends)
    gaps = polled.withColumn("_to", F.lead("i").over(Window.partitionBy("ticker").orderBy("i"))).filter(F.col("_to") > F.col("i") + 1)
    first, last = numbered.select(F.col("i").alias("_a"), F.col("cycle_start").alias("first_missing")), numbered.select(F.col("i").alias("_z"), F.col("cycle_start").alias("last_missing"))
    gaps = gaps.select("ticker", (F.col("i") + 1).alias("_a"), (F.col("_to") - 1).alias("_z"))
    return gaps.join(first, "_a").join(last, "_z").select("ticker", "first_missing", "last_missing", (F.col("_z") - F.col("_a") + 1).alias("n"))


def counted(stream: DataFrame, root: str, name: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Counts (`n` per the other columns) over a whole stream: every batch writes its own, which are summed on reading.

    No state and no watermark, so an item is counted however late it comes.
    """
    spark, out = stream.sparkSession, count(stream)
    _run(stream, root, name, lambda df, batch_id: write_batch(count(df), root, name, batch_id))
    by = [c for c in out.columns if c != "n"]
    return read_batches(spark, root, name, ddl(out)).groupBy(*by).agg(F.sum("n").alias("n"))


def in_session(items: DataFrame, t: str, sessions: DataFrame) -> DataFrame:
    return A.with_session(items, t, sessions, "left_semi")


def run_available(stream: DataFrame, root: str, name: str) -> DataFrame:
    """Process everything that has arrived, one written partition per batch, and read it back (empty if nothing came)."""
    _run(stream, root, name, lambda df, batch_id: write_batch(df, root, name, batch_id))
    return read_batches(stream.sparkSession, root, name, ddl(stream))


def recency_run(items: DataFrame, root: str, name: str, t: str, hours: int = 24) -> DataFrame:
    """Sliding count and time since the previous item, against everything seen up to each batch.

    Items are kept by day (`state.ItemState`): a batch reads the days from its first item's window on and one row per
    ticker for what came before, however long the stream has run. Items count from `t` on.
    """
    spark = items.sparkSession
    state = ItemState(spark, f"{root}/{name}_state")

    def step(df: DataFrame, batch_id: int) -> None:
        arrivals = df.select("ticker", F.col(t).alias("nt"))
        write_batch(state.recency(df, arrivals, batch_id, t, hours), root, name, batch_id)
        state.add_arrivals(arrivals, batch_id)

    _run(items, root, name, step)
    return read_batches(spark, root, name, f"{ddl(items)}, hours_since_prev double, items_prior long").drop("batch_id")


@dataclass
class LiveRun:
    """One live decision path: lag log, late gate, features, scores, decision log, signals, outcomes.

    `score` maps a frame of features to one with class probabilities p0..p3 and `severity`; `calibrate`, if given, maps
    that frame to one with calibrated p0..p3. `severe_edges` are the outer label edges of the training scores
    (`labels.threshold_edges`). Items may carry a `live_price`, which goes before the last close.
    """

    spark: SparkSession
    root: str
    bars: DataFrame
    sessions: DataFrame
    patterns: DataFrame
    score: object
    thresholds: dict[str, float]
    severe_edges: tuple[float, float]
    suppressed_until: DataFrame | None = None
    calibrate: Callable[[DataFrame], DataFrame] | None = None
    sentiment: Callable[[DataFrame], DataFrame] = X.word_list_scorer
    min_bars: int = P.MIN_HOURLY_BARS
    features: FeatureState | None = None
    cache_days: int = 7
    bar_payload: list[str] = field(default_factory=lambda: ["close"])

    def __post_init__(self) -> None:
        checkpoint_dir(self.spark)
        self.seen = ItemState(self.spark, f"{self.root}/seen")

    def _features(self, ok: DataFrame, flow: DataFrame) -> DataFrame:
        """The batch's feature rows; items in warm-up drop. The late gate leaves a day or two of publishing times."""
        if self.features is None:
            tech = E.last_completed_hour(flow, E.hourly_indicators(E.hourly_bars(self.bars)), "published_utc", E.INDICATORS, self.min_bars)
            return tech.filter("hb IS NOT NULL").select("news_hash", "hours_since_prev", "items_prior", "hb.*")
        out = None
        for day in sorted(r.d for r in ok.select(F.to_date("published_utc").alias("d")).distinct().collect()):
            mine = F.to_date("published_utc") == F.lit(day)
            frame = self.features.frame(ok.filter(mine), day, flow.filter(mine))
            out = frame if out is None else out.unionByName(frame)
        if out is None:
            return self.features.frame(ok, dt.date(1970, 1, 1), flow).drop("ticker", "published_utc", *R.SENTIMENT)
        return out.drop("ticker", "published_utc", *R.SENTIMENT)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. The items count as seen only after their signals are written.

        It reads the hashes of its items' publishing days, the arrivals of the last two days, the scores of the last
        `cache_days` days and, with `features`, the bars of its items' days: not the whole history.
        """
        h = C.news_hash(F.col("news_source"), F.col("ticker"), F.col("headline"), F.unix_seconds("published_utc"))
        fresh = self.seen.unseen(earliest(batch.withColumn("news_hash", h), "arrival"), batch_id).checkpoint()
        # Passing mentions leave before anything is logged about them.
        relevant = enrich(fresh, self.patterns).filter("relevance_tier < 3")
        # The batch scorer over the headline, each text once: what earlier batches scored lately is a table.
        first = fresh.agg(F.min(F.to_date("arrival")).alias("d")).first().d
        since = first - dt.timedelta(days=self.cache_days) if first else None
        cache = read_days(self.spark, f"{self.root}/scores", X.SCORES, since, None, batch_id).dropDuplicates(["text_hash"])
        scored, new = X.score_with_cache(relevant, "headline", cache, self.sentiment)
        tagged = with_lag(scored, "published_utc", "arrival").checkpoint()
        write_day(new.withColumn("_d", F.lit(first).cast("date")), f"{self.root}/scores", "_d", batch_id)
        write_batch(tagged.select("news_hash", "ticker", "headline", "published_utc", "arrival", "lag_minutes", "rejected_stale"), self.root, "retrieval_lag", batch_id)
        ok = tagged.filter("rejected_stale = 0")
        write_batch(tagged.filter("rejected_stale = 1").select("news_hash", "ticker", "headline", "lag_minutes"), self.root, "stale_rejections", batch_id)

        arrived = fresh.select("ticker", F.col("arrival").alias("nt"))
        flow = self.seen.recency(ok.select("news_hash", "ticker", "published_utc"), arrived, batch_id, "published_utc")
        rows = ok.join(self._features(ok, flow), "news_hash")
        live = F.col("live_price").cast("double") if "live_price" in rows.columns else F.lit(None).cast("double")
        priced = A.entry_price_with_fallback(rows.withColumn("_live", live), self.bars, "_live", "arrival").drop("_live")
        probs = ["p0", "p1", "p2", "p3"]
        scored = self.score(priced).withColumn("prob_raw", F.greatest(*probs))
        decided = L.decide(self.calibrate(scored) if self.calibrate else scored, probs, self.thresholds)
        if self.suppressed_until is not None:
            decided = A.suppress(decided, self.suppressed_until, "published_utc").drop("until_ts")
        else:
            decided = decided.withColumn("suppressed", F.lit(False))
        final = L.finalize_decision(decided, "severity", F.lit(self.severe_edges[0]), F.lit(self.severe_edges[1]), "suppressed")
        final = O.stop_level(final, "atr_pct").withColumn("dedup_group_id", C.story_group(F.col("ticker"), "published_utc"))
        given = [(F.col(c) if c in final.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("url", "string"), ("n_symbols", "int"))]
        out = final.select(
            F.xxhash64("news_hash").alias("signal_id"), "news_hash", "ticker", "published_utc", "class_name", "prob_calibrated", "prob_raw", "severity", "severe", "entry_price", "entry_source", "stop_price", "headline", *given, "status",
            "suppress_reason", "news_source", "dedup_group_id", F.col("hours_since_prev").cast("double").alias("hours_since_prev"), F.col("items_prior").cast("long").alias("items_prior"),
        ).checkpoint()
        write_batch(out, self.root, "decision_log", batch_id)
        write_batch(out, self.root, "signals", batch_id)
        self.seen.add(fresh, batch_id)

    def run(self, items: DataFrame, every: str | None = None):
        """Process all that has arrived, or with `every` ('120 seconds') start one batch a period and return the query."""
        query = start(items, self.root, "live", self.process, every)
        if every is None:
            query.awaitTermination()
        return query


def resolve_outcomes(signals: DataFrame, outcomes: DataFrame, bars: DataFrame, now, horizon_min: int = P.HORIZON_BARS, grace_min: int = 5) -> DataFrame:
    """Outcomes of all signals, fired or silent, whose horizon and grace have passed and that have none yet."""
    due = A.pending_outcomes(signals, outcomes, A.after(now, -(horizon_min + grace_min)))
    numbered = A.with_exit(bars).select("ticker", "idx", "ts", "open", "high", "low", "close")
    windows = O.wall_clock_window(due, numbered, "ts_utc", horizon_min)
    last = numbered.select("ticker", F.col("idx").alias("exit_idx"), F.col("ts").alias("exit_ts"), F.col("close").alias("exit_price"))
    trades = windows.drop("exit_price").join(last, ["ticker", "exit_idx"]).withColumn("direction", F.lit("long")).withColumn("stop_dist", F.col("entry_price") - F.col("stop_price"))
    return O.trade_returns(O.first_touch_exit(trades, numbered)).select(
        "signal_id", "exit_ts", F.col("exit_fill").alias("exit_price"), F.col("stopped").cast("int").alias("stopped"), F.col("gross_ret").alias("ret_gross"), F.col("net_ret").alias("ret_net")
    )


@dataclass
class OutcomeRun:
    """Outcomes of signals while signals and bars arrive, in any order.

    The clock is the latest bar time less `disorder_min`. A signal is due once the clock has passed its horizon and grace
    and a bar at or after its horizon is there; due signals are resolved by `resolve_outcomes` from the bars of their days
    on, and each is written once. Open signals are carried from batch to batch as one table, and what each batch adds is
    its own partition, so a replay repeats itself.

    A bar that comes later than `disorder_min` behind the latest one and falls into the window of a resolved signal makes
    that signal due again; its new outcome has a higher `revision` and `outcomes` returns the highest. So any order of
    arrival ends in the batch result, and with bars in time (up to `disorder_min`) nothing is written twice.
    """

    spark: SparkSession
    root: str
    disorder_min: int = 0
    horizon_min: int = P.HORIZON_BARS
    grace_min: int = 5

    SIGNALS = "signal_id long, ticker string, ts_utc timestamp, entry_price double, stop_price double"
    OUTCOMES = "signal_id long, exit_ts timestamp, exit_price double, stopped int, ret_gross double, ret_net double"
    DONE = f"{SIGNALS}, until timestamp"

    def __post_init__(self) -> None:
        checkpoint_dir(self.spark)

    def _snapshot(self, name: str, schema: str, batch_id: int) -> DataFrame:
        """What the newest batch before this one left."""
        held = sorted(int(n.split("=")[1]) for n in children(self.spark, f"{self.root}/{name}") if n.startswith("batch_id="))
        before = [b for b in held if b < batch_id]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch_id={before[-1]}") if before else self.spark.createDataFrame([], schema)

    def step(self, rows: DataFrame, batch_id: int) -> None:
        """One batch of `arrivals` rows: bars and signals mixed."""
        bars = rows.filter("signal IS NULL").select("bar.*")
        write_day(bars, f"{self.root}/bars", "ts", batch_id)
        last = self._snapshot("last_bars", "ticker string, last_ts timestamp", batch_id)
        reached = last.unionByName(bars.select("ticker", F.col("ts").alias("last_ts"))).groupBy("ticker").agg(F.max("last_ts").alias("last_ts"))
        write_batch(reached, self.root, "last_bars", batch_id)
        reached = read_batches(self.spark, self.root, "last_bars", "ticker string, last_ts timestamp").filter(F.col("batch_id") == batch_id).drop("batch_id")
        before, now = last.agg(F.max("last_ts").alias("t")).first().t, reached.agg(F.max("last_ts").alias("t")).first().t

        waiting = self._snapshot("open", self.SIGNALS, batch_id).unionByName(rows.filter("signal IS NOT NULL").select("signal.*"))
        # Resolved signals whose window a late bar has changed are open again.
        again = self._changed(bars, before, batch_id) if before is not None else None
        if again is not None:
            waiting = waiting.unionByName(again)
        waiting = waiting.dropDuplicates(["signal_id"]).checkpoint()
        if now is None:
            write_batch(waiting, self.root, "open", batch_id)
            return
        clock = F.lit(now) - F.expr(f"INTERVAL {self.disorder_min} MINUTES")
        target = A.after("ts_utc", self.horizon_min)
        due = waiting.join(reached, "ticker").filter((A.after("ts_utc", self.horizon_min + self.grace_min) <= clock) & (F.col("last_ts") >= target)).drop("last_ts").checkpoint()
        first = due.agg(F.min(F.to_date("ts_utc")).alias("d")).first().d
        done = self.spark.createDataFrame([], self.OUTCOMES)
        if first is not None:
            history = read_days(self.spark, f"{self.root}/bars", BARS, first, None, batch_id + 1)
            done = resolve_outcomes(due, done, history, F.lit(now), self.horizon_min, self.grace_min).checkpoint()
        write_batch(done, self.root, "outcomes", batch_id)
        write_day(due.join(done.select("signal_id", F.col("exit_ts").alias("_x")), "signal_id").withColumn("until", F.greatest("_x", target)).drop("_x"), f"{self.root}/resolved", "ts_utc", batch_id)
        write_batch(waiting.join(done, "signal_id", "left_anti"), self.root, "open", batch_id)

    def _changed(self, bars: DataFrame, before, batch_id: int) -> DataFrame | None:
        """Signals that earlier batches resolved and whose window [ts, horizon bar] holds a bar of this batch."""
        late = bars.filter(F.col("ts") <= F.lit(before)).select("ticker", F.col("ts").alias("_late"), F.to_date("ts").alias("_d")).checkpoint()
        span = late.agg(F.min("_d").alias("a")).first()
        if span.a is None:
            return None
        # A window may have begun days before its last bar: as far back as any resolved one has reached.
        held = [d for d in days_of(self.spark, f"{self.root}/resolved")]
        if not held:
            return None
        done = read_days(self.spark, f"{self.root}/resolved", self.DONE, None, None, batch_id).filter(F.to_date("until") >= F.lit(span.a))
        listed = done.withColumn("_d", F.explode(F.sequence(F.to_date("ts_utc"), F.to_date("until"))))
        hit = listed.join(late, ["ticker", "_d"]).filter((F.col("_late") >= F.col("ts_utc")) & ((F.col("_late") <= F.col("until")) | (F.col("_late") <= A.after("ts_utc", self.horizon_min))))
        return hit.select(*[c.split()[0] for c in self.SIGNALS.split(", ")])

    def arrivals(self, signals: DataFrame, bars: DataFrame) -> DataFrame:
        """Signals and bars as one stream."""
        signal_type = f"struct<{', '.join(c.replace(' ', ': ') for c in self.SIGNALS.split(', '))}>"
        bar_type = f"struct<{', '.join(c.replace(' ', ': ') for c in BARS.split(', '))}>"
        s = signals.select(F.struct(*[c.split()[0] for c in self.SIGNALS.split(", ")]).cast(signal_type).alias("signal"), F.lit(None).cast(bar_type).alias("bar"))
        b = bars.select(F.lit(None).cast(signal_type).alias("signal"), F.struct(*[c.split()[0] for c in BARS.split(", ")]).cast(bar_type).alias("bar"))
        return s.unionByName(b)

    def run(self, signals: DataFrame, bars: DataFrame, every: str | None = None):
        query = start(self.arrivals(signals, bars), self.root, "outcomes", self.step, every)
        if every is None:
            query.awaitTermination()
        return query

    def outcomes(self) -> DataFrame:
        """The last outcome of every resolved signal; `revision` counts from 1 the times it was written."""
        rows = read_batches(self.spark, self.root, "outcomes", self.OUTCOMES)
        return rows.groupBy("signal_id").agg(F.max_by(F.struct(*[c.split()[0] for c in self.OUTCOMES.split(", ")[1:]]), "batch_id").alias("_o"), F.count(F.lit(1)).alias("revision")).select("signal_id", "_o.*", "revision")
