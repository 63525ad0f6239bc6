"""Token counts by an exact length histogram.

Every whole text is encoded and only its length leaves the task. Lengths are counted (map side first), which leaves one
row per distinct length however many documents there are. Sums from the long end of this table answer, for any context
limit: documents and tokens above it, the total with every document cut to the limit, and quantiles. The sums run in two
levels (blocks of lengths, then inside a block), so no task holds the whole table.

Null and empty texts have length 0 and are counted. Repeated rows count each. An empty table has an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_view, keep, slices, text_column
from .tokenize import default_vocabulary, word_encoder

BLOCK = 512


def lengths(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The encoded length of every text, in no order."""
    vocabulary = vocabulary or default_vocabulary()

    def count(batches):
        encoder = word_encoder(vocabulary)
        for batch in batches:
            texts = text_column(batch, text)
            _, offsets = byte_view(texts)
            for a, b in slices(offsets, 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(encoder.encode(texts.slice(a, b - a))[1]))], names=["length"])

    return df.select(text).mapInArrow(count, "length long")


def histogram(df: DataFrame, **options) -> DataFrame:
    """(length, docs) of every distinct length."""
    return lengths(df, **options).groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length, used as context limit: length, docs, docs_over, tokens_over (both strictly above), docs_total,
    tokens_total, truncated_total (every document cut to the limit) and share_within (documents that fit whole)."""
    hist = keep(hist, "histogram").withColumn("_block", F.floor(F.col("length") / BLOCK))
    above = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum(F.col("docs") * F.col("length")).alias("_tokens"))
    total = blocks.agg(F.sum("_docs").alias("docs_total"), F.sum("_tokens").alias("tokens_total"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs"), F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.withColumn("_d", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("_t", F.coalesce(F.sum(F.col("docs") * F.col("length")).over(inside), F.lit(0)))
    rows = rows.join(blocks, "_block").withColumn("docs_over", F.col("_d") + F.col("_docs")).withColumn("tokens_over", F.col("_t") + F.col("_tokens"))
    return rows.join(total, F.lit(True)).select(
        "length", "docs", "docs_over", "tokens_over", "docs_total", "tokens_total",
        truncated_total(F.col("length"), F.col("tokens_total"), F.col("tokens_over"), F.col("docs_over")).alias("truncated_total"),
        (1 - F.col("docs_over") / F.col("docs_total")).alias("share_within"),
    )


def truncated_total(limit: Column, tokens_total: Column, tokens_over: Column, docs_over: Column) -> Column:
    return tokens_total - tokens_over + limit * docs_over


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """The row of suffix sums for each context limit: exact for limits between lengths too, by the greatest length that
    is not above the limit (a limit under all lengths has every document over it)."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.first("docs_total").alias("docs_total"), F.first("tokens_total").alias("tokens_total"))
    below = sums.join(asked, F.col("length") <= F.col("context_limit")).groupBy("context_limit").agg(F.max_by(F.struct("docs_over", "tokens_over"), "length").alias("s"))
    out = asked.join(below, "context_limit", "left").join(total, F.lit(True))
    docs_over, tokens_over = F.coalesce("s.docs_over", "docs_total"), F.coalesce("s.tokens_over", "tokens_total")
    return out.select("context_limit", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "tokens_total", truncated_total(F.col("context_limit"), F.col("tokens_total"), tokens_over, docs_over).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q the least length that at least q of the documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    within = F.col("docs_total") - F.col("docs_over")
    return sums.join(asked, within >= F.ceil(F.col("share") * F.col("docs_total"))).groupBy("share").agg(F.min("length").alias("length"))
