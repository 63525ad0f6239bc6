"""Append-only log tables and small results on Parquet, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import LOGS

# Column that gives a log's `day` partition.
LOG_TIME = {"outcomes": "filled_at", "seen_news": "first_seen_utc", "signal_insert_log": "logged_at_utc"}


def append_log(df: DataFrame, root: str, name: str) -> None:
    """Append rows in the log's own column order and types."""
    fields = [f.strip().rsplit(" ", 1) for f in LOGS[name].split(",")]
    typed = df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in fields])
    typed.withColumn("day", F.to_date(LOG_TIME.get(name, "ts_utc"))).write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(f"{LOGS[name]}, day date").parquet(f"{root}/{name}")


def write_batch(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    """Write a stream batch to its own partition; a replay of the batch overwrites it."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def with_added_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows read null in columns that were added later."""
    return old.unionByName(new, allowMissingColumns=True)


def write_by_month(df: DataFrame, path: str, t: str) -> None:
    df.withColumn("month", F.date_format(t, "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """A result table of a few rows (per class, per bin, per cell) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_small_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def universe_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Configured (ticker, sector) pairs as a dimension table."""
    return spark.createDataFrame(rows, "ticker string, sector string")
