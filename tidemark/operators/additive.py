"""A classifier whose statistics add up: Gaussian naive Bayes over all folds and trials in one pass.

A row enters as counts, sums and squares per day and class; what a fold trains on is a sum of days, so expanding folds
need no pass of their own, and trials differ only in how the same sums are read. Scores are plain column expressions.

Defined cases: a missing or NaN feature says nothing about its row; a feature that doesn't vary in the training rows is not
used; a class that lacks values of a feature takes the pooled ones; a class absent from the training rows has probability
0; rows without a label train nothing; a fold without training rows gives null probabilities and a null prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.labels import assign_folds

#: Share of a feature's pooled variance added to that of each class.
SMOOTHING = 1e-9
#: A variance below this share of the mean square is rounding.
ROUNDING = 1e-12


def _value(f: str) -> Column:
    x = F.col(f).cast("double")
    return F.when(~F.isnan(x), x)


def moments(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """Rows (`by`, _k, _i, _n, _s, _q, _c): per class and feature count, sum and sum of squares around the common mean.

    Feature -1 counts rows. The mean _c only centres the sums, so that squares keep their digits; it does not enter the
    model. Features are dealt into rows inside a task and added up there before the shuffle, so the generated code does not
    grow with their number.
    """
    centre = df.agg(*[F.coalesce(F.avg(_value(f)), F.lit(0.0)).alias(f) for f in features]).select(F.struct("*")).scalar()
    rows = df.filter(F.col(label).isNotNull()).withColumn("_mid", centre)
    cells = [F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("d"), F.lit(0.0).alias("c"))]
    for i, f in enumerate(features):
        mid = F.col("_mid").getField(f)
        cells.append(F.struct(F.lit(i).alias("i"), (_value(f) - mid).alias("d"), mid.alias("c")))
    x = rows.select(*by, F.col(label).alias("_k"), F.explode(F.array(*cells)).alias("_x"))
    d = F.col("_x.d")
    return x.groupBy(*by, "_k", F.col("_x.i").alias("_i")).agg(
        F.count(d).alias("_n"), F.coalesce(F.sum(d), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("_q"), F.max("_x.c").alias("_c")
    )


def add_up(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of larger groups from those of smaller ones."""
    return parts.groupBy(*by, "_k", "_i").agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_q")], F.max("_c").alias("_c"))


def parameters(sums: DataFrame, by: Sequence[str], n_classes: int = 4, smoothing: str | None = None, balanced: str | None = None) -> DataFrame:
    """One row per `by`: array _a by feature, after an entry of log priors, of means m and variances v per class.

    `smoothing` and `balanced` name columns of `by`; without them SMOOTHING and balanced classes.
    """
    extra = F.col(smoothing) if smoothing else F.lit(SMOOTHING)
    even = F.col(balanced) if balanced else F.lit(True)
    k_all = range(n_classes)
    one = lambda k, c: F.coalesce(F.sum(F.when(F.col("_k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    wide = sums.groupBy(*by, "_i").agg(*[one(k, c) for k in k_all for c in ("_n", "_s", "_q")], F.max("_c").alias("_c"))

    def spread(c: Column, s: Column, q: Column) -> tuple[Column, Column]:
        mean = F.try_divide(s, c)
        return mean, F.when(c > 0, F.greatest(F.try_divide(q, c) - mean * mean, F.lit(0.0)))

    c, s, q = (sum(F.col(f"{x}{k}") for k in k_all) for x in ("_n", "_s", "_q"))
    mean, var = spread(c, s, q)
    used = (var > F.try_divide(q, c) * ROUNDING) & (F.col("_i") >= 0)
    own = [spread(F.col(f"_n{k}"), F.col(f"_s{k}"), F.col(f"_q{k}")) for k in k_all]
    present = sum((F.col(f"_n{k}") > 0).cast("int") for k in k_all)
    prior = [F.when(F.col(f"_n{k}") > 0, F.when(even, -F.ln(present)).otherwise(F.ln(F.col(f"_n{k}") / c))) for k in k_all]
    m = F.when(F.col("_i") < 0, F.array(*prior)).when(used, F.array(*[F.coalesce(a, mean) + F.col("_c") for a, _ in own]))
    v = F.when(used, F.array(*[F.coalesce(b, var) + extra * var for _, b in own]))
    return wide.select(*by, F.struct("_i", m.alias("m"), v.alias("v")).alias("_f")).groupBy(*by).agg(F.sort_array(F.collect_list("_f")).alias("_a"))


def score(df: DataFrame, params: DataFrame, by: Sequence[str], features: Sequence[str], n_classes: int = 4) -> DataFrame:
    """Add q0..qk and `pred` (ties: the smaller class) by the parameters of the row's `by`; one row of them if `by` is empty."""
    rows = df.join(params, list(by), "left") if by else df.withColumn("_a", params.select("_a").scalar())
    logs = []
    for k in range(n_classes):
        log = F.get(F.get("_a", F.lit(0)).getField("m"), F.lit(k))
        for i, f in enumerate(features):
            entry = F.get("_a", F.lit(i + 1))
            v = F.get(entry.getField("v"), F.lit(k))
            d = _value(f) - F.get(entry.getField("m"), F.lit(k))
            log = log - F.coalesce((F.ln(v) + d * d / v) / 2, F.lit(0.0))
        logs.append(log.alias(f"_l{k}"))
    rows = rows.select(*df.columns, *logs)
    best = F.greatest(*[F.col(f"_l{k}") for k in range(n_classes)])
    rows = rows.select(*df.columns, *[F.when(best.isNotNull(), F.coalesce(F.exp(F.col(f"_l{k}") - best), F.lit(0.0))).alias(f"_e{k}") for k in range(n_classes)])
    total = sum(F.col(f"_e{k}") for k in range(n_classes))
    rows = rows.select(*df.columns, *[(F.col(f"_e{k}") / total).alias(f"q{k}") for k in range(n_classes)])
    top = F.greatest(*[F.col(f"q{k}") for k in range(n_classes)])
    pred = F.coalesce(*[F.when(F.col(f"q{k}") == top, k) for k in range(n_classes)])
    return rows.withColumn("pred", pred)


def holdout(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, n_classes: int = 4) -> DataFrame:
    """Probabilities of `test` by the model of `train`."""
    params = parameters(moments(train, [], features, label), [], n_classes)
    return score(test, params, [], features, n_classes)


def fold_moments(df: DataFrame, t: str, folds: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Moments of every fold's training rows. The rows are read once, into one row per day; folds add up days."""
    daily = moments(df.withColumn("_day", F.to_date(t)), ["_day"], features, label).withColumnRenamed("_day", "day")
    return add_up(assign_folds(daily, "day", folds).filter("part = 'train'").drop("part", "day"), ["fold"])


def out_of_fold(df: DataFrame, t: str, folds: DataFrame, features: Sequence[str], label: str, n_classes: int = 4) -> DataFrame:
    """Probabilities of every tested row by the model of its own fold, all folds in one pass."""
    params = parameters(fold_moments(df, t, folds, features, label), ["fold"], n_classes)
    return score(assign_folds(df, t, folds).filter("part = 'test'"), params, ["fold"], features, n_classes)


def search(df: DataFrame, t: str, folds: DataFrame, features: Sequence[str], label: str, grid: Sequence[tuple[float, bool]], n_classes: int = 4) -> DataFrame:
    """One row per trial (smoothing, balanced): mean macro-F1 over the folds, over the classes that occur in a fold's test.

    All trials read the same moments; the driver starts one job for the whole table.
    """
    trials = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(s).alias("smoothing"), F.lit(b).alias("balanced")) for i, (s, b) in enumerate(grid)])
    sums = fold_moments(df, t, folds, features, label).withColumn("_t", F.explode(trials)).select("*", "_t.*")
    params = parameters(sums, ["trial", "fold", "smoothing", "balanced"], n_classes, "smoothing", "balanced").drop("smoothing", "balanced")
    tested = assign_folds(df, t, folds).filter("part = 'test'").select("fold", label, *[f for f in features if f != label])
    rows = score(tested.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))), params, ["trial", "fold"], features, n_classes)
    hits = rows.groupBy("trial", "fold").agg(*[
        F.struct(F.count_if(F.col(label) == k).alias("n"), F.count_if(F.col("pred") == k).alias("p"), F.count_if((F.col(label) == k) & (F.col("pred") == k)).alias("tp")).alias(f"_{k}")
        for k in range(n_classes)
    ])
    f1 = [F.when(F.col(f"_{k}.n") > 0, 2 * F.col(f"_{k}.tp") / (F.col(f"_{k}.n") + F.col(f"_{k}.p"))) for k in range(n_classes)]
    occur = sum((F.col(f"_{k}.n") > 0).cast("int") for k in range(n_classes))
    macro = hits.select("trial", "fold", F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)), occur).alias("f"))
    out = macro.groupBy("trial").agg(F.avg("f").alias("value")).withColumn("_t", F.element_at(trials, F.col("trial") + 1))
    return out.select("trial", "value", "_t.smoothing", "_t.balanced")
