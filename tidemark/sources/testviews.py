"""Market-shaped views over the check tables, in Spark and as DuckDB common table expressions.

The Spark side is what a user would build from landed files; the SQL side says the same for the
oracle. A view name means the same thing on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.schemas import TEST_TABLES
from tidemark.session import checkpoint_dir, configure


class Views:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TEST_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def keep(self, df: DataFrame) -> DataFrame:
        """Cut the lineage of a costly result that several later steps read (reliable checkpoint)."""
        checkpoint_dir(self.spark)
        return df.checkpoint()

    # ---- bars and calendar -------------------------------------------------------------
    def bars(self, key: str = "event_type") -> DataFrame:
        ticker = F.col("event_type") if key == "event_type" else F.concat(F.lit("U"), F.col(key))
        return (
            self.table("events")
            .groupBy(ticker.alias("ticker"), F.date_trunc("minute", "ts").alias("ts"))
            .agg(
                F.min_by("value", "event_id").alias("open"),
                F.max("value").alias("high"),
                F.min("value").alias("low"),
                F.max_by("value", "event_id").alias("close"),
                F.count(F.lit(1)).alias("volume"),
            )
        )

    def calendar(self) -> DataFrame:
        """Trading days with wall-clock times; Sundays are closed."""
        days = self.table("events").select(F.to_date("ts").alias("d")).distinct().filter(F.dayofweek("d") != 1)
        return days.select("d", F.date_format("d", "yyyy-MM-dd").alias("date"), F.lit("06:00").alias("open"), F.lit("2200").alias("close"))

    def sessions(self) -> DataFrame:
        d = F.col("d").cast("timestamp")
        return self.calendar().select(
            "d", (d + F.expr("INTERVAL 6 HOURS")).alias("sess_start"), (d + F.expr("INTERVAL 22 HOURS")).alias("sess_end")
        )

    def daily(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("c"), F.sum("l_quantity").alias("v"))
        )

    def tickers(self) -> DataFrame:
        """The tickers of `daily`, without its days."""
        return self.table("lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("ticker")).distinct()

    def bench(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.to_date("l_shipdate").alias("d"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("c"))
        )

    # ---- news and signals ----------------------------------------------------------------
    def news(self) -> DataFrame:
        """News items; the headline is the first sentence, the summary the whole text."""
        docs, ev = self.table("documents"), self.table("events")
        return docs.join(ev, docs.doc_id == ev.event_id).select(
            F.col("doc_id").alias("news_id"),
            F.col("event_type").alias("ticker"),
            F.regexp_extract("text", r"^[^.\n]*", 0).alias("headline"),
            F.col("text").alias("summary"),
            "source",
            "lang",
            F.col("ts").alias("published_utc"),
        )

    def signals(self) -> DataFrame:
        v, i = F.col("value"), F.col("event_id")
        cls = F.when(v < 10, "Sell").when(v < 45, "Neutral").when(v < 100, "Buy").otherwise("Strong Buy")
        return self.table("events").select(
            i.alias("signal_id"),
            F.col("ts").alias("ts_utc"),
            F.col("event_type").alias("ticker"),
            cls.alias("class_name"),
            F.when((v >= 45) & (i % 3 == 0), "fired").otherwise("silent").alias("status"),
            v.alias("entry_price"),
            F.timestamp_micros(F.unix_micros("ts") + (i % 90) * 60_000_000).alias("arrival"),
            F.when(i % 2 == 0, "feed1").otherwise("feed2").alias("news_source"),
            (i % 4).cast("int").alias("n_symbols"),
        )

    def universe(self) -> DataFrame:
        return (
            self.table("events")
            .select(F.col("event_type").alias("ticker"))
            .distinct()
            .withColumn("sector", F.when(F.col("ticker").isin("click", "view"), "A").otherwise("B"))
        )

    # ---- filings ---------------------------------------------------------------------------
    def filings(self) -> DataFrame:
        issuer = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("issuer"))
        o = self.table("orders")
        return o.join(issuer, o.o_orderkey == issuer.l_orderkey).select(
            F.col("o_orderkey").alias("accession"),
            F.to_date("o_orderdate").alias("filing_date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "4/A").otherwise("4").alias("document_type"),
            F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("aff10b5one"),
            "issuer",
        )

    def filing_lines(self) -> DataFrame:
        code = F.when(F.col("l_returnflag") == "R", "P").when(F.col("l_returnflag") == "A", "S").otherwise("M")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("accession"),
            code.alias("trans_code"),
            F.col("l_quantity").alias("shares"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )

    def owners(self) -> DataFrame:
        return self.owner_lines().distinct()

    def owner_lines(self) -> DataFrame:
        """Owners as often as the filing names them."""
        p = F.col("l_partkey")
        title = F.when(p % 5 == 0, "Chief Executive Officer").when(p % 5 == 1, "CFO").otherwise("Other")
        return (
            self.table("lineitem")
            .select(
                F.col("l_orderkey").alias("accession"),
                (p % 500).alias("owner"),
                title.alias("title"),
                F.when(p % 2 == 0, "Director").otherwise("Officer").alias("relationship"),
            )
        )

    # ---- class scores ------------------------------------------------------------------------
    def scored(self) -> DataFrame:
        """Binary truth with a hash-noised score."""
        return self.table("labels").select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y"),
            F.col("toxic").alias("grp"),
            (F.lit(0.5) * F.col("quality") + F.lit(0.5) * uniform("doc_id")).alias("p"),
        )

    def probs(self) -> DataFrame:
        """Four-class probabilities (hash draws tilted to the true class) with day, score and truth."""
        v = F.col("value")
        y = F.when(v < 10, 0).when(v < 45, 1).when(v < 100, 2).otherwise(3)
        raw = [
            uniform(F.concat_ws("#", F.lit(str(k)), F.col("event_id").cast("string"))) + F.when(y == k, 0.6).otherwise(0.0)
            for k in range(4)
        ]
        base = self.table("events").select(
            F.col("event_id").alias("id"), F.col("ts"), F.col("event_type").alias("ticker"), v.alias("value"),
            y.alias("y"), *[r.alias(f"r{k}") for k, r in enumerate(raw)],
        )
        s = F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")
        return base.select("id", "ts", "ticker", "value", "y", *[(F.col(f"r{k}") / s).alias(f"p{k}") for k in range(4)])

    def trades(self) -> DataFrame:
        """Closed trades: direction, return, stop and benchmark excess per event."""
        i, v = F.col("event_id"), F.col("value")
        ret = (F.pmod(i * 37, F.lit(401)) - 195) / F.lit(10000.0) + v / F.lit(100000.0)
        return self.table("events").select(
            i.alias("trade_id"),
            F.col("event_type").alias("ticker"),
            F.col("ts").alias("entry_ts"),
            F.to_date("ts").alias("day"),
            F.when(i % 4 == 0, "short").otherwise("long").alias("direction"),
            (v >= 100).alias("severe"),
            ret.alias("net_ret"),
            (ret + F.lit(0.0006)).alias("gross_ret"),
            F.when(i % 11 == 0, F.lit(None)).otherwise(ret - v / F.lit(200000.0)).cast("double").alias("excess"),
            (i % 3 == 0).alias("stopped"),
        )


U_SQL = "(('0x'||substr(md5(CAST({x} AS VARCHAR)),1,8))::UBIGINT/4294967295.0)"

SQL_VIEWS: dict[str, str] = {
    "bars_v": (
        "SELECT event_type AS ticker, date_trunc('minute', ts) AS ts, min_by(value,event_id) AS open, max(value) AS high, "
        "min(value) AS low, max_by(value,event_id) AS close, count(*) AS volume FROM events GROUP BY 1,2"
    ),
    "sessions_v": (
        "SELECT CAST(d AS DATE) AS d, d + INTERVAL '6' HOUR AS sess_start, d + INTERVAL '22' HOUR AS sess_end FROM "
        "(SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events) x WHERE dayofweek(d) <> 0"
    ),
    "sess_bars_v": (
        "SELECT b.*, s.d, s.sess_start, s.sess_end FROM bars_v b JOIN sessions_v s ON b.ts >= s.sess_start AND b.ts < s.sess_end"
    ),
    "daily_v": (
        "SELECT concat('S',l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice)/sum(l_quantity) AS c, "
        "sum(l_quantity) AS v FROM lineitem GROUP BY 1,2"
    ),
    "bench_v": "SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice)/sum(l_quantity) AS c FROM lineitem GROUP BY 1",
    "news_v": (
        "SELECT d.doc_id AS news_id, e.event_type AS ticker, regexp_extract(d.text, '^[^.\\n]*') AS headline, d.text AS summary, "
        "d.source, d.lang, e.ts AS published_utc FROM documents d JOIN events e ON e.event_id = d.doc_id"
    ),
    "signals_v": (
        "SELECT event_id AS signal_id, ts AS ts_utc, event_type AS ticker, CASE WHEN value < 10 THEN 'Sell' WHEN value < 45 THEN "
        "'Neutral' WHEN value < 100 THEN 'Buy' ELSE 'Strong Buy' END AS class_name, CASE WHEN value >= 45 AND event_id % 3 = 0 THEN "
        "'fired' ELSE 'silent' END AS status, value AS entry_price, ts + INTERVAL '1' MINUTE * (event_id % 90) AS arrival, "
        "CASE WHEN event_id % 2 = 0 THEN 'feed1' ELSE 'feed2' END AS news_source, event_id % 4 AS n_symbols FROM events"
    ),
    "universe_v": (
        "SELECT DISTINCT event_type AS ticker, CASE WHEN event_type IN ('click','view') THEN 'A' ELSE 'B' END AS sector FROM events"
    ),
    "filings_v": (
        "SELECT o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderpriority='1-URGENT' THEN '4/A' "
        "ELSE '4' END AS document_type, CASE WHEN o_orderstatus='F' THEN '1' ELSE '0' END AS aff10b5one, i.issuer FROM orders JOIN "
        "(SELECT l_orderkey, min(l_suppkey) AS issuer FROM lineitem GROUP BY 1) i ON i.l_orderkey=o_orderkey"
    ),
    "filing_lines_v": (
        "SELECT l_orderkey AS accession, CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'A' THEN 'S' ELSE 'M' END AS trans_code, "
        "l_quantity AS shares, l_extendedprice/l_quantity AS price FROM lineitem"
    ),
    "owners_v": (
        "SELECT DISTINCT l_orderkey AS accession, l_partkey % 500 AS owner, CASE l_partkey % 5 WHEN 0 THEN 'Chief Executive Officer' "
        "WHEN 1 THEN 'CFO' ELSE 'Other' END AS title, CASE WHEN l_partkey % 2 = 0 THEN 'Director' ELSE 'Officer' END AS relationship "
        "FROM lineitem"
    ),
    "scored_v": (
        "SELECT doc_id AS id, quality AS y, toxic AS grp, 0.5*quality + 0.5*" + U_SQL.format(x="doc_id") + " AS p FROM labels"
    ),
    "probs_v": (
        "SELECT id, ts, ticker, value, y, r0/(r0+r1+r2+r3) AS p0, r1/(r0+r1+r2+r3) AS p1, r2/(r0+r1+r2+r3) AS p2, r3/(r0+r1+r2+r3) AS p3 "
        "FROM (SELECT event_id AS id, ts, event_type AS ticker, value, y, "
        + ", ".join(
            U_SQL.format(x=f"'{k}#'||event_id") + f" + CASE WHEN y={k} THEN 0.6 ELSE 0.0 END AS r{k}" for k in range(4)
        )
        + " FROM (SELECT *, CASE WHEN value<10 THEN 0 WHEN value<45 THEN 1 WHEN value<100 THEN 2 ELSE 3 END AS y FROM events))"
    ),
    "trades_v": (
        "SELECT trade_id, ticker, entry_ts, day, direction, severe, net_ret, net_ret + 0.0006::DOUBLE AS gross_ret, "
        "CASE WHEN trade_id % 11 = 0 THEN NULL ELSE net_ret - value/200000.0::DOUBLE END AS excess, stopped FROM ("
        "SELECT event_id AS trade_id, event_type AS ticker, ts AS entry_ts, CAST(ts AS DATE) AS day, "
        "CASE WHEN event_id % 4 = 0 THEN 'short' ELSE 'long' END AS direction, value >= 100 AS severe, value, "
        "((event_id*37) % 401 - 195)/10000.0::DOUBLE + value/100000.0::DOUBLE AS net_ret, event_id % 3 = 0 AS stopped FROM events)"
    ),
}


def oracle(body: str, **extra: str) -> str:
    """Prefix `body` with the views it (or another used view) names. `extra` adds named queries."""
    views = {**SQL_VIEWS, **extra}

    def used(text: str, seen: list[str]) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and name not in seen:
                used(views[name], [*seen, name])
                order.append(name) if name not in order else None

    order: list[str] = []
    used(body, [])
    if not order:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({views[n]})" for n in order) + " " + body
