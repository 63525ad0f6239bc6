"""Labels, splits, baselines, classification metrics, thresholds and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions.hashing import hash32, uniform
from tidemark.functions.scan import cumulative_sums, exact_quantiles, first_per_key, rank_rows


# ---- labels ---------------------------------------------------------------------------------------
def vol_normalized(events: DataFrame, ret: str, sigma: str, out: str = "score") -> DataFrame:
    return events.filter((F.col(sigma) > 0) & F.col(ret).isNotNull()).withColumn(out, F.col(ret) / F.col(sigma))


def threshold_edges(train: DataFrame, score: str, quantiles: Sequence[float] = P.LABEL_QUANTILES) -> DataFrame:
    """One row with `edges`: exact quantiles of the training scores."""
    names = {f"e{i}": q for i, q in enumerate(quantiles)}
    return exact_quantiles(train, [], score, names).select(F.array(*names).alias("edges"))


def digitize(df: DataFrame, score: str, edges: DataFrame, out: str = "label") -> DataFrame:
    """Label = number of edges at or below the score."""
    with_edges = df.withColumn("_edges", edges.scalar())
    return with_edges.withColumn(out, F.size(F.filter("_edges", lambda e: e <= F.col(score)))).drop("_edges")


def merge_classes(label: str, mapping: Sequence[int] = P.MERGE_5_TO_4) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in mapping]), F.col(label) + 1)


# ---- splits ------------------------------------------------------------------------------------------
def holdout_split(df: DataFrame, t: str, start: Column, embargo_days: int = P.HOLDOUT_EMBARGO_DAYS) -> DataFrame:
    """`part` is train before start minus the embargo, test from start on, null in between."""
    cut = start - F.expr(f"INTERVAL {embargo_days} DAYS")
    return df.withColumn("part", F.when(F.col(t) < cut, "train").when(F.col(t) >= start, "test"))


def walk_forward_folds(df: DataFrame, t: str, n_folds: int = P.CV_FOLDS, embargo_days: int = P.HOLDOUT_EMBARGO_DAYS, initial_days: int = P.INITIAL_TRAIN_DAYS) -> DataFrame:
    """Fold table over day blocks: the days after the first `initial_days` are cut into equal blocks;
    each fold tests one block and trains on all days before it, minus the embargo. One row per fold,
    built from the distinct days only."""
    days = df.select(F.to_date(t).alias("day")).distinct()
    ranked = days.withColumn("i", F.row_number().over(Window.orderBy("day"))).filter(F.col("i") > initial_days)
    blocks = ranked.withColumn("fold", F.ntile(n_folds).over(Window.orderBy("day")))
    return blocks.groupBy("fold").agg(F.min("day").alias("test_start"), F.max("day").alias("test_end")).withColumn(
        "train_before", F.date_sub("test_start", embargo_days)
    )


def assign_folds(df: DataFrame, t: str, folds: DataFrame) -> DataFrame:
    """Rows with the folds they take part in and their `part` there. The few folds enter as an array."""
    packed = folds.agg(F.sort_array(F.collect_list(F.struct("fold", "test_start", "test_end", "train_before"))).alias("f")).scalar()
    day = F.to_date(t)
    f = F.col("_f")
    part = F.when(day < f.train_before, "train").when((day >= f.test_start) & (day <= f.test_end), "test")
    return df.withColumn("_f", F.explode(packed)).withColumn("fold", f.fold).withColumn("part", part).filter("part IS NOT NULL").drop("_f")


def weekly_blocks(df: DataFrame, t: str, embargo_days: int = P.HOLDOUT_EMBARGO_DAYS) -> DataFrame:
    """Per Monday: test rows of the week and training rows before Monday minus the embargo."""
    per_day = df.groupBy(F.to_date(t).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_day.select("day", "n", F.sum("n").over(run).alias("cum"))
    weeks = per_day.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week_start")).agg(F.sum("n").alias("n_test"))
    weeks = weeks.withColumn("_cut", F.date_sub("week_start", embargo_days))
    from tidemark.functions.scan import asof

    j = asof(weeks, cum, [], "_cut", "day", ["cum"], exact=False, block=None)
    return j.select("week_start", "n_test", F.coalesce("m.cum", F.lit(0)).alias("n_train"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c), k = number of classes present."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = c.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.withColumn("weight", tot.select(F.try_divide(F.col("n"), F.col("k"))).scalar() / F.col("n_class"))


# ---- baselines and metrics --------------------------------------------------------------------------------
def frequency_random(df: DataFrame, train: DataFrame, label: str, key: str, seed: str, n_classes: int = 4, out: str = "pred") -> DataFrame:
    """Class drawn by hash with the training frequencies."""
    f = train.agg(*[F.avg((F.col(label) == k).cast("double")).alias(f"f{k}") for k in range(n_classes)])
    cum = f.select(F.array(*[sum((F.col(f"f{j}") for j in range(1, k + 1)), F.col("f0")) for k in range(n_classes - 1)]))
    u = uniform(F.lit(seed), F.col(key).cast("string"))
    return df.withColumn("_cum", cum.scalar()).withColumn(out, F.size(F.filter("_cum", lambda c: c <= u))).drop("_cum")


def sentiment_rule(score: Column, neutral: int = 1, buy: int = 2, sell: int = 0, cut: float = 0.5) -> Column:
    return F.when(score > cut, buy).when(score < -cut, sell).otherwise(neutral)


def confusion_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, pred: str, n_classes: int = 4) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual")).pivot(pred, list(range(n_classes))).count().na.fill(0).select(
        "actual", *[F.col(str(k)).alias(f"pred_{k}") for k in range(n_classes)]
    )


def per_class_report(df: DataFrame, y: str, pred: str, n_classes: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class, from the k x k counts."""
    c = confusion_counts(df, y, pred)
    cells = c.select(F.explode(F.array(*[F.lit(k) for k in range(n_classes)])).alias("class_id"), "actual", "predicted", "n")
    g = cells.groupBy("class_id").agg(
        F.sum(F.when((F.col("actual") == F.col("class_id")) & (F.col("predicted") == F.col("class_id")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("predicted") == F.col("class_id"), F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("actual") == F.col("class_id"), F.col("n")).otherwise(0)).alias("support"),
    )
    p = F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pp") + F.col("support")), F.lit(0.0))
    return g.select("class_id", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def classification_summary(df: DataFrame, y: str, pred: str, n_classes: int = 4) -> DataFrame:
    """Accuracy, macro-F1 over the classes that occur, and ordinal error."""
    macro = per_class_report(df, y, pred, n_classes).filter("support > 0 OR precision > 0 OR f1 > 0").agg(F.avg("f1")).scalar()
    return df.agg(
        F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), F.avg(F.abs(F.col(y) - F.col(pred)).cast("double")).alias("ordinal_mae")
    ).withColumn("macro_f1", macro)


def wrong_direction(df: DataFrame, y: str, pred: str, actual: Sequence[int] = (2, 3), wrong: Sequence[int] = (0,)) -> DataFrame:
    g = df.filter(F.col(y).isin(*actual)).groupBy(F.col(y).alias("actual"))
    hit = F.col(pred).isin(*wrong)
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_wrong"), F.avg(hit.cast("double")).alias("wrong_rate"))


def equal_count_bin(pos: Column, n: Column, k: int) -> Column:
    """Bin 1..k of rank `pos` among `n` rows, the first n mod k bins one row larger."""
    q, extra = F.floor(n / k), n % k
    big = extra * (q + 1)
    return F.when(pos <= big, F.ceil(pos / (q + 1))).otherwise(extra + F.ceil((pos - big) / F.when(q > 0, q))).cast("int")


def with_bins(df: DataFrame, value: str, tie: str, k: int, out: str = "bin") -> DataFrame:
    """Equal-count bins by (value, tie) over all rows, without a global single-task sort."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return rank_rows(df, [], value, tie, out="_pos").withColumn(out, equal_count_bin(F.col("_pos"), n, k)).drop("_pos")


def reliability(df: DataFrame, prob: str, hit: Column, tie: str, k: int) -> DataFrame:
    """Per equal-count bin: size, mean predicted probability and the class frequency."""
    b = with_bins(df.withColumn("_hit", hit.cast("double")), prob, tie, k)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_pred"), F.avg("_hit").alias("emp_freq"))


def best_trial(trials: DataFrame, value: str, params: Sequence[str], trial: str) -> DataFrame:
    """Parameters of the best trial, the earliest on ties."""
    best = F.max_by(F.struct(trial, value, *params), F.struct(F.col(value), -F.col(trial)))
    return trials.filter(F.col(value).isNotNull()).agg(best.alias("b")).select("b.*")


# ---- thresholds and decisions ---------------------------------------------------------------------------------
def threshold_curve(df: DataFrame, prob: str, hit: Column, step: float | None = None) -> DataFrame:
    """Precision, recall and fire rate of every threshold: each distinct probability, or those of a grid with `step`.

    Probabilities are counted before anything moves; the running sums from the top are scanned in blocks, or in one window
    over the grid, which has at most 1 / step + 1 rows.
    """
    k = round(1 / step) if step else None
    value = F.floor(F.round(F.col(prob) * k, 9)) / F.lit(float(k)) if step else F.col(prob).cast("double")
    g = df.filter(F.col(prob).isNotNull()).groupBy((-value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(hit).alias("_h"))
    total = g.agg(F.sum("_n").alias("n_all"), F.sum("_h").alias("h_all"))
    if k:
        top = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        scanned = g.select("*", F.sum("_n").over(top).alias("fired"), F.sum("_h").over(top).alias("hits"))
    else:
        scanned = cumulative_sums(g, [], {"fired": F.col("_n"), "hits": F.col("_h")})
    sums = scanned.withColumn("_t", total.select(F.struct("*")).scalar())
    return sums.select(
        (-F.col("_v")).alias("threshold"), "fired", F.try_divide("hits", "fired").alias("precision"), F.try_divide("hits", F.col("_t.h_all")).alias("recall"), F.try_divide("fired", F.col("_t.n_all")).alias("fire_rate")
    )


def choose_threshold(curve: DataFrame, floor: float, min_fire: float = P.MIN_FIRE_RATE, max_fire: float = P.MAX_FIRE_RATE) -> DataFrame:
    """Lowest threshold that reaches the precision floor with a fire rate inside the band; no row if none does."""
    ok = curve.filter((F.col("precision") >= floor) & F.col("fire_rate").between(min_fire, max_fire))
    best = F.min_by(F.struct("threshold", "fired", "precision", "recall", "fire_rate"), "threshold")
    return ok.agg(best.alias("b")).filter("b IS NOT NULL").select("b.*")


def decide(df: DataFrame, probs: Sequence[str], thresholds: dict[str, float], names: Sequence[str] = P.CLASSES_4, suppressed: Sequence[str] = ("Sell",)) -> DataFrame:
    """First class of the priority list at or above its threshold, else the most likely one, silent."""
    col = dict(zip(names, probs, strict=True))
    fired = prob = None
    for c in P.DECISION_PRIORITY:
        if thresholds.get(c) is None or c in suppressed:
            continue
        hit = F.col(col[c]) >= thresholds[c]
        fired = F.when(hit, c) if fired is None else fired.when(hit, c)
        prob = F.when(hit, F.col(col[c])) if prob is None else prob.when(hit, F.col(col[c]))
    top = F.greatest(*probs)
    best = None
    for n in names:
        best = F.when(F.col(col[n]) == top, n) if best is None else best.when(F.col(col[n]) == top, n)
    fired = fired if fired is not None else F.lit(None).cast("string")
    prob = prob if prob is not None else F.lit(None).cast("double")
    return df.withColumn("_f", fired).select(
        "*", F.when(F.col("_f").isNotNull(), "fired").otherwise("silent").alias("status"), F.coalesce("_f", best).alias("class_name"), F.coalesce(prob, top).alias("prob_calibrated")
    ).drop("_f")


def finalize_decision(df: DataFrame, severity: str, severe_sell: Column, severe_buy: Column, suppressed_flag: str, suppressed: Sequence[str] = ("Sell",)) -> DataFrame:
    """Severity flag, final status and reason; a corporate-action suppression overrides both."""
    longs = F.col("class_name").isin(*P.LONG_CLASSES)
    severe = ((F.col("class_name") == "Sell") & (F.col(severity) <= severe_sell)) | (longs & (F.col(severity) >= severe_buy))
    reason = (
        F.when(F.col(suppressed_flag), "corporate_action").when(F.col("status") == "fired", "")
        .when(F.col("class_name").isin(*suppressed) & (F.col("class_name") == "Sell"), "sell_side_suppressed").otherwise("below_threshold")
    )
    return df.withColumn("severe", F.coalesce(severe, F.lit(False)).cast("int")).withColumn("suppress_reason", reason).withColumn(
        "status", F.when(F.col(suppressed_flag), "silent").otherwise(F.col("status"))
    )


# ---- parity and sampling ------------------------------------------------------------------------------------------
def parity(a: DataFrame, b: DataFrame, key: str, features: Sequence[str], group: str, ok_below: float = 1e-6, drift_from: float = 1e-3) -> DataFrame:
    """Worst relative feature difference per group between two builds of the same rows."""
    long_a = a.select(key, group, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key, group], list(features), "feature", "va")
    long_b = b.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], list(features), "feature", "vb")
    diff = F.abs(F.col("va") - F.col("vb")) / F.greatest(F.abs("vb"), F.lit(1e-12))
    rel = F.when(F.col("va").isNull() & F.col("vb").isNull(), 0.0).otherwise(F.coalesce(diff, F.lit(float("inf"))))
    g = long_a.join(long_b, [key, "feature"]).withColumn("rel", rel).groupBy(group).agg(
        F.countDistinct(key).alias("n"), F.max("rel").alias("max_rel_diff"), F.min_by("feature", F.struct(-F.col("rel"), F.col("feature"))).alias("worst_feature")
    )
    flag = F.when(F.col("max_rel_diff") < ok_below, "OK").when(F.col("max_rel_diff") < drift_from, "~").otherwise("DIFF")
    return g.withColumn("flag", flag)


def random_row_per_key(df: DataFrame, key: str, row_id: str, seed: str) -> DataFrame:
    h = hash32(F.lit(seed), F.col(row_id).cast("string"))
    return first_per_key(df.withColumn("_h", h), [key], ["_h", row_id]).drop("_h")
