"""Isotonic calibration maps as tables: fitted in blocks of scores, applied by an as-of join.

Pooling adjacent violators gives the same steps in whatever order neighbours are pooled. So every block of the ordered
scores is pooled on its own, and only its steps go on to be pooled per class. With labels of 0 and 1 there are few: steps
have different means, fractions whose denominators are the steps' row counts, so N rows hold at most some N^(2/3) of them.

Defined cases: rows with a null label train nothing; null and NaN scores neither train nor get a value; steps of equal mean
are one; a score between two steps is interpolated, one beyond the ends takes the end's value; a class without training rows
gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scan import asof, value_blocks

#: Buckets of scores in the as-of join; they only decide how work is cut.
BUCKETS = 4096
SUMS = "class_id int, x_lo double, x_hi double, s long, w long"


def pool(steps: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators among one class's ordered steps, in exact integers."""
    steps = steps.sort_values("x_lo")
    out: list[list] = []
    for lo, hi, s, w in zip(steps.x_lo.tolist(), steps.x_hi.tolist(), steps.s.tolist(), steps.w.tolist(), strict=True):
        while out and out[-1][2] * w >= s * out[-1][3]:
            lo, _, s0, w0 = out.pop()
            s, w = s + s0, w + w0
        out.append([lo, hi, s, w])
    kept = pd.DataFrame(out, columns=["x_lo", "x_hi", "s", "w"])
    kept.insert(0, "class_id", steps.class_id.iloc[0])
    return kept


def _long(df: DataFrame, scores: Sequence[str], *keep: Column) -> DataFrame:
    """One row per class with its score; null and NaN scores dropped."""
    cells = F.array(*[F.struct(F.lit(k).alias("class_id"), F.col(p).cast("double").alias("x")) for k, p in enumerate(scores)])
    return df.select(*keep, F.explode(cells).alias("_s")).select("*", "_s.*").drop("_s").filter(F.col("x").isNotNull() & ~F.isnan("x"))


def fit(df: DataFrame, label: str, scores: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """Steps (class_id, x_lo, x_hi, y, w) of the map from the k-th score to the share of label k. `parts` cuts the work."""
    rows = _long(df.filter(F.col(label).isNotNull()), scores, F.col(label).alias("_y"))
    counts = rows.groupBy("class_id", "x").agg(F.count_if(F.col("_y") == F.col("class_id")).alias("s"), F.count(F.lit(1)).alias("w"))
    placed = value_blocks(counts, ["class_id"], "x", parts)
    cells = placed.select("class_id", F.col("x").alias("x_lo"), F.col("x").alias("x_hi"), "s", "w", "_blk")
    pooled = cells.groupBy("class_id", "_blk").applyInPandas(lambda g: pool(g), SUMS)
    steps = pooled.groupBy("class_id").applyInPandas(lambda g: pool(g), SUMS)
    return steps.select("class_id", "x_lo", "x_hi", (F.col("s") / F.col("w")).alias("y"), "w")


def breakpoints(steps: DataFrame) -> DataFrame:
    """The ends of the steps as points (class_id, x, y); a step on a single score is one point."""
    ends = F.when(F.col("x_lo") == F.col("x_hi"), F.array("x_lo")).otherwise(F.array("x_lo", "x_hi"))
    return steps.select("class_id", F.explode(ends).alias("x"), "y")


def apply(df: DataFrame, steps: DataFrame, scores: Sequence[str], key: str) -> DataFrame:
    """Add c0.., the mapped scores divided by their sum (by one if it is zero). `key` is unique."""
    n = len(scores)
    w = Window.partitionBy("class_id").orderBy("x_lo")
    below = F.lit(float("-inf"))
    marks = steps.select(
        "class_id", F.when(F.row_number().over(w) == 1, below).otherwise(F.col("x_lo")).alias("x_lo"), "x_hi", "y", F.lead("x_lo").over(w).alias("next_x"), F.lead("y").over(w).alias("next_y")
    )

    def bucket(c: str) -> Column:
        return F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * BUCKETS).cast("long")

    long = _long(df, scores, F.col(key))
    at = asof(long, marks, ["class_id"], "x", "x_lo", ["x_lo", "x_hi", "y", "next_x", "next_y"], block=bucket)
    rise = (F.col("m.next_y") - F.col("m.y")) * (F.col("x") - F.col("m.x_hi")) / (F.col("m.next_x") - F.col("m.x_hi"))
    y = F.when((F.col("x") <= F.col("m.x_hi")) | F.col("m.next_x").isNull(), F.col("m.y")).otherwise(F.col("m.y") + rise)
    mapped = at.groupBy(key).agg(*[F.max(F.when(F.col("class_id") == k, y)).alias(f"_c{k}") for k in range(n)])
    total = sum(F.col(f"_c{k}") for k in range(n))
    safe = F.when(total == 0, 1.0).otherwise(total)
    return df.join(mapped, key, "left").select(*df.columns, *[(F.col(f"_c{k}") / safe).alias(f"c{k}") for k in range(n)])
