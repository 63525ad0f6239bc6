"""Classifiers, calibration and severity on Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scan import exact_quantiles
from tidemark.operators.labels import assign_folds, class_weights, classification_summary
from tidemark.operators.stats import correlations

MakeModel = Callable[[], Estimator]


def forest(trees: int = 20, depth: int = 5, seed: int = 42) -> Estimator:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, make: MakeModel = forest) -> Model:
    """Impute, assemble and fit with balanced class weights."""
    weighted = train.join(class_weights(train, label).select(label, "weight"), label).withColumn("label", F.col(label).cast("double"))
    doubles = weighted.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    x = [f"_x_{f}" for f in features]
    filled = [f"_i_{f}" for f in features]
    return Pipeline(stages=[Imputer(inputCols=x, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), make()]).fit(doubles)


def predict_probs(model: Model, df: DataFrame, features: Sequence[str], n_classes: int = 4) -> DataFrame:
    """Add q0..qk class probabilities and `pred`."""
    x = df.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    out = model.transform(x).withColumn("_p", vector_to_array("probability"))
    probs = [F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)).alias(f"q{k}") for k in range(n_classes)]
    return out.select(*df.columns, *probs, F.col("prediction").cast("int").alias("pred"))


def out_of_fold(df: DataFrame, t: str, folds: DataFrame, features: Sequence[str], label: str, make: MakeModel = forest) -> DataFrame:
    """Probabilities of every tested row by the model of its own fold."""
    parts = assign_folds(df, t, folds)
    out = None
    for (k,) in folds.select("fold").orderBy("fold").collect():  # a handful of folds
        one = parts.filter(F.col("fold") == k)
        m = fit_classifier(one.filter("part = 'train'"), features, label, make)
        p = predict_probs(m, one.filter("part = 'test'"), features)
        out = p if out is None else out.unionByName(p)
    return out


def grid_search(df: DataFrame, t: str, folds: DataFrame, features: Sequence[str], label: str, grid: Sequence[dict]) -> DataFrame:
    """One row per trial: its parameters and the mean macro-F1 over the folds."""
    spark = df.sparkSession
    rows = []
    for i, p in enumerate(grid):
        oof = out_of_fold(df, t, folds, features, label, lambda p=p: forest(**p))
        per_fold = [classification_summary(oof.filter(F.col("fold") == k), label, "pred").first()["macro_f1"] for (k,) in folds.select("fold").collect()]
        rows.append((i, float(sum(per_fold) / len(per_fold)), p.get("trees"), p.get("depth")))
    return spark.createDataFrame(rows, "trial int, value double, trees int, depth int")


def fit_isotonic(df: DataFrame, label: str, probs: Sequence[str]) -> list[IsotonicRegressionModel]:
    """One isotonic map per class, fitted on the counts of every distinct probability."""
    models = []
    for k, p in enumerate(probs):
        g = df.groupBy(F.col(p).alias("x")).agg(F.avg((F.col(label) == k).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        models.append(IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="_c").fit(g))
    return models


def calibrate(df: DataFrame, models: Sequence[IsotonicRegressionModel], probs: Sequence[str]) -> DataFrame:
    """Calibrated probabilities c0.., renormalised; a zero sum divides by one."""
    out = df
    for k, (m, p) in enumerate(zip(models, probs, strict=True)):
        out = m.transform(out.withColumn("x", F.col(p))).withColumnRenamed("_c", f"_c{k}").drop("x")
    raw = [F.col(f"_c{k}") for k in range(len(probs))]
    total = sum(raw[1:], raw[0])
    safe = F.when(total == 0, 1.0).otherwise(total)
    return out.select(*df.columns, *[(c / safe).alias(f"c{k}") for k, c in enumerate(raw)])


def calibration_steps(df: DataFrame, models: Sequence[IsotonicRegressionModel]) -> DataFrame:
    """Breakpoints of the maps as a table (class_id, x, y)."""
    rows = [(k, float(x), float(y)) for k, m in enumerate(models) for x, y in zip(m.boundaries, m.predictions, strict=True)]
    return df.sparkSession.createDataFrame(rows, "class_id int, x double, y double")


def fit_severity(train: DataFrame, features: Sequence[str], score: str, iterations: int = 10, depth: int = 4) -> Model:
    """Boosted regressor on the score winsorised at its 5% and 95% quantiles."""
    q = exact_quantiles(train, [], score, {"lo": 0.05, "hi": 0.95})
    clipped = train.withColumn("_q", q.select(F.struct("*")).scalar()).withColumn("label", F.least(F.greatest(F.col(score), F.col("_q.lo")), F.col("_q.hi"))).drop("_q")
    x = clipped.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    ins, outs = [f"_x_{f}" for f in features], [f"_i_{f}" for f in features]
    gbt = GBTRegressor(featuresCol="features", labelCol="label", lossType="absolute", maxIter=iterations, maxDepth=depth, seed=42, predictionCol="pred_score")
    return Pipeline(stages=[Imputer(inputCols=ins, outputCols=outs), VectorAssembler(inputCols=outs, outputCol="features"), gbt]).fit(x)


def severity_metrics(model: Model, test: DataFrame, features: Sequence[str], score: str, lo: float, hi: float) -> DataFrame:
    """Rank correlation, absolute error and hit rates of the two severe flags of the model's predictions."""
    x = test.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    return prediction_metrics(model.transform(x).select(F.col(score).alias("s"), "pred_score"), lo, hi)


def prediction_metrics(p: DataFrame, lo: float, hi: float) -> DataFrame:
    """The same for given predictions: `s` the true score, `pred_score` the predicted one."""
    low, high = F.col("pred_score") <= lo, F.col("pred_score") >= hi
    m = p.agg(
        F.avg(F.abs(F.col("s") - F.col("pred_score"))).alias("mae"), F.count_if(low).alias("n_low"), F.avg(F.when(low, (F.col("s") <= lo).cast("double"))).alias("low_hit"),
        F.count_if(high).alias("n_high"), F.avg(F.when(high, (F.col("s") >= hi).cast("double"))).alias("high_hit"),
    )
    return m.withColumn("spearman", correlations(p, "pred_score", "s").select("spearman").scalar())


def importances(model: Model, df: DataFrame, features: Sequence[str], groups: dict[str, str]) -> DataFrame:
    """Importance per feature with its group's share."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(f, groups.get(f, "other"), float(v)) for f, v in zip(features, imp, strict=True)]
    return with_group_share(df.sparkSession.createDataFrame(rows, "feature string, grp string, importance double"))


def with_group_share(t: DataFrame) -> DataFrame:
    """Importances (feature, grp, importance) with their group's share of the total, largest first."""
    g = t.groupBy("grp").agg(F.sum("importance").alias("_g"))
    total = t.agg(F.sum("importance")).scalar()
    return t.join(g, "grp").withColumn("group_share", F.try_divide("_g", total)).drop("_g").orderBy(F.col("importance").desc(), "feature")


