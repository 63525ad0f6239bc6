"""Readers for landed files and parsers for nested payloads. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as S

ET = "America/New_York"


def read_news(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON array per ticker; the ticker is the file name."""
    raw = spark.read.schema(S.NEWS_RAW).option("multiLine", True).json(folder)
    return raw.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def news_shape(raw: DataFrame) -> DataFrame:
    """Common news shape; rows without headline or time drop."""
    return raw.dropna(subset=["headline", "datetime"]).select(
        "id", "ticker", "headline", "summary", "source", "url", F.col("datetime").cast("long").alias("published_epoch"),
        F.timestamp_seconds("datetime").alias("published_utc"),
    )


def read_bars(spark: SparkSession, folder: str, suffix: str = "_1min") -> DataFrame:
    """Bar CSVs named <ticker><suffix>.csv with vendor letters as headers."""
    raw = spark.read.schema(S.BAR_CSV).option("header", True).csv(f"{folder}/*{suffix}.csv")
    named = raw.withColumnsRenamed(S.BAR_NAMES)
    return named.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){suffix}\\.csv$", 1))


def benchmark_closes(daily_bars: DataFrame, benchmark: str) -> DataFrame:
    return daily_bars.filter(F.col("ticker") == benchmark).select(F.to_date("ts").alias("d"), F.col("close").alias("c"))


def et_time(date: Column, hhmm: Column) -> Column:
    """UTC timestamp of an ET wall-clock time written HH:MM or HHMM."""
    digits = F.lpad(F.regexp_replace(hhmm, ":", ""), 4, "0")
    local = F.to_timestamp(F.concat(date, F.lit(" "), digits), "yyyy-MM-dd HHmm")
    return F.to_utc_timestamp(local, ET)


def sessions_from_calendar(calendar: DataFrame) -> DataFrame:
    d = F.col("date")
    return calendar.select(F.to_date(d).alias("d"), et_time(d, F.col("open")).alias("sess_start"), et_time(d, F.col("close")).alias("sess_end"))


def read_filing_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """One of the filing TSVs over all quarter folders, pruned to `columns`; all values are text, by the header's names."""
    return spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/*/{name}.tsv").select(*columns)


def read_holdings(spark: SparkSession, path: str, row_tag: str = "invstOrSec") -> DataFrame:
    raw = spark.read.schema(S.HOLDING_XML).option("rowTag", row_tag).xml(path)
    num = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("valUSD", "balance", "pctVal")}
    typed = raw.withColumns(num)
    return typed.withColumn("price", F.try_divide("valUSD", "balance"))


def report_date(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repPdDate string").option("rowTag", "genInfo").xml(path).select(F.to_date("repPdDate").alias("report_date"))


def corporate_actions(payloads: DataFrame, column: str, universe: DataFrame) -> DataFrame:
    """Responses {kind: [rows]} to one row per action of a universe ticker.

    The plural is cut from the kind; a row matches by `symbol` or `source_symbol`, never by the
    new symbol of a spin-off.
    """
    parsed = payloads.select(F.from_json(column, S.CORPORATE_ACTIONS).alias("p")).select(F.explode("p.corporate_actions").alias("kind", "rows"))
    rows = parsed.select(F.regexp_replace("kind", "s$", "").alias("type"), F.explode("rows").alias("a"))
    named = rows.select("type", F.col("a.ex_date").alias("ex_date"), F.explode(F.array_distinct(F.filter(F.array("a.symbol", "a.source_symbol"), lambda s: s.isNotNull()))).alias("ticker"))
    return named.filter("ex_date IS NOT NULL").join(universe.select("ticker"), "ticker", "left_semi").select("ticker", "ex_date", "type")


def explode_articles(articles: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per (article, tracked symbol), with the article's number of symbols."""
    rows = articles.withColumn("n_symbols", F.size("symbols")).withColumn("ticker", F.explode("symbols")).drop("symbols")
    return rows.join(universe.select("ticker"), "ticker", "left_semi")


def feed_shape(items: DataFrame, default_source: str = "feed2") -> DataFrame:
    """Second feed in the common raw shape; unparsable times drop."""
    ts = F.try_to_timestamp("created_at")
    named = items.withColumn("datetime", F.unix_seconds(ts)).filter("datetime IS NOT NULL")
    blank = F.coalesce(F.col("source"), F.lit("")) == ""
    return named.withColumn("source", F.when(blank, default_source).otherwise(F.col("source"))).withColumn("category", F.lit("")).drop("created_at")


def daily_bars_from_map(df: DataFrame, column: str) -> DataFrame:
    """{symbol: [bar, ...]} to long daily rows, first bar per (ticker, date), zero volume dropped."""
    from tidemark.functions.scan import first_per_key

    parsed = df.select(F.explode(F.from_json(column, f"map<string,{S.DAILY_JSON}>")).alias("ticker", "bars"))
    rows = parsed.select("ticker", F.posexplode("bars").alias("pos", "b")).select("ticker", "pos", F.to_date("b.t").alias("d"), "b.o", "b.h", "b.l", "b.c", "b.v")
    return first_per_key(rows, ["ticker", "d"], ["pos"]).drop("pos").filter("v > 0")
