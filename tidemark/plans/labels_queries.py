"""Registered queries: labels, splits, baselines, metrics, thresholds and decisions."""

from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import features as E
from tidemark.operators import labels as L
from tidemark.operators.align import after
from tidemark.plans.features_queries import AV, SIG
from tidemark.plans.alignment_queries import regular
from tidemark.plans.registry import query


def r(c, n=9, name=None):
    return F.round(c, n).alias(name or c)


# Returns and sigma of signals: a signed return over the trailing sigma of its ticker.
SC = "SELECT signal_id, ticker, ts_utc, (entry_price - 40)/sigma AS score, (entry_price - 40) AS ret, sigma FROM sigma_v s JOIN signals_v USING (signal_id, ticker, ts_utc) WHERE sigma > 0"
SV = {**AV, "sigma_v": SIG, "score_v": SC}


def scored_signals(v):
    s = v.signals().select("signal_id", "ticker", "ts_utc", (F.col("entry_price") - 40).alias("ret"))
    return L.vol_normalized(E.trailing_sigma(s, E.sigma_anchors(regular(v)), "ts_utc", 10), "ret", "sigma")


@query("f1_vol_normalized", "SELECT signal_id, round(score,7) AS score FROM score_v", **SV)
def f1(v):
    return scored_signals(v).select("signal_id", r("score", 7))


EDGES = "SELECT quantile_cont(score,0.10) AS e0, quantile_cont(score,0.35) AS e1, quantile_cont(score,0.65) AS e2, quantile_cont(score,0.90) AS e3 FROM score_v WHERE ts_utc < (SELECT max(ts) FROM events) - INTERVAL '2' DAY"


def pool(v):
    newest = v.table("events").agg(F.max("ts"))
    s = v.keep(scored_signals(v))
    return s, s.filter(F.col("ts_utc") < newest.select(after(F.col("max(ts)"), -2 * 24 * 60)).scalar())


@query("f2_threshold_edges", "SELECT round(e0,7) AS e0, round(e1,7) AS e1, round(e2,7) AS e2, round(e3,7) AS e3 FROM edges_v", **SV, edges_v=EDGES)
def f2(v):
    e = L.threshold_edges(pool(v)[1], "score")
    return e.select(*[F.round(F.col("edges")[i], 7).alias(f"e{i}") for i in range(4)])


LAB = "SELECT s.*, (score >= e0)::INT + (score >= e1)::INT + (score >= e2)::INT + (score >= e3)::INT AS label FROM score_v s, edges_v"


@query("f3_digitize", "SELECT label, count(*) AS n, round(min(score),6) AS lo, round(max(score),6) AS hi FROM lab_v GROUP BY 1", **SV, edges_v=EDGES, lab_v=LAB)
def f3(v):
    s, train = pool(v)
    d = L.digitize(s, "score", L.threshold_edges(train, "score"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("lo"), F.round(F.max("score"), 6).alias("hi"))


@query("f4_merge_classes", "SELECT CASE label WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE label-1 END AS label4, count(*) AS n FROM lab_v GROUP BY 1", **SV, edges_v=EDGES, lab_v=LAB)
def f4(v):
    s, train = pool(v)
    d = L.digitize(s, "score", L.threshold_edges(train, "score"))
    return d.groupBy(L.merge_classes("label").alias("label4")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f5_holdout_split",
    "SELECT CASE WHEN ts_utc < TIMESTAMP '2024-01-24' - INTERVAL '1' DAY THEN 'train' WHEN ts_utc >= TIMESTAMP '2024-01-24' THEN 'test' END AS part, count(*) AS n FROM signals_v GROUP BY 1",
)
def f5(v):
    s = L.holdout_split(v.signals(), "ts_utc", F.lit("2024-01-24").cast("timestamp"))
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


FOLDS = "SELECT fold, min(day) AS test_start, max(day) AS test_end, min(day) - 1 AS train_before FROM (SELECT day, ntile(3) OVER (ORDER BY day) AS fold FROM (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(ts_utc AS DATE) AS day FROM signals_v)) WHERE i > 10) GROUP BY 1"


@query(
    "f6_walk_forward_folds",
    "SELECT f.fold, CASE WHEN CAST(s.ts_utc AS DATE) < f.train_before THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM signals_v s JOIN folds_v f ON CAST(s.ts_utc AS DATE) < f.train_before OR CAST(s.ts_utc AS DATE) BETWEEN f.test_start AND f.test_end GROUP BY 1,2",
    folds_v=FOLDS,
)
def f6(v):
    s = v.signals()
    a = L.assign_folds(s, "ts_utc", L.walk_forward_folds(s, "ts_utc", initial_days=10))
    return a.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f7_weekly_blocks",
    "SELECT w AS week_start, n_test, (SELECT count(*) FROM signals_v s WHERE CAST(s.ts_utc AS DATE) < x.w - 1) AS n_train FROM (SELECT CAST(date_trunc('week', ts_utc) AS DATE) AS w, count(*) AS n_test FROM signals_v GROUP BY 1) x",
)
def f7(v):
    return L.weekly_blocks(v.signals(), "ts_utc")


@query("f8_class_weights", "SELECT y, count(*) AS n_class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS weight FROM probs_v GROUP BY 1")
def f8(v):
    return L.class_weights(v.probs(), "y").select("y", "n_class", r("weight"))


@query(
    "f10_best_trial",
    "SELECT trial, round(value,9) AS value, depth FROM (SELECT CAST(substr(source,4) AS INT) AS trial, avg(n_chars) AS value, count(*) AS depth FROM documents GROUP BY 1) ORDER BY value DESC, trial LIMIT 1",
)
def f10(v):
    t = v.table("documents").groupBy(F.substring("source", 4, 9).cast("int").alias("trial")).agg(F.avg("n_chars").alias("value"), F.count(F.lit(1)).alias("depth"))
    return L.best_trial(t, "value", ["depth"], "trial").select("trial", r("value"), "depth")


ARG = "CASE WHEN p0 = greatest(p0,p1,p2,p3) THEN 0 WHEN p1 = greatest(p0,p1,p2,p3) THEN 1 WHEN p2 = greatest(p0,p1,p2,p3) THEN 2 ELSE 3 END"
PRED = f"SELECT *, {ARG} AS pred, greatest(p0,p1,p2,p3) AS conf FROM probs_v"


def predicted(v):
    top = F.greatest("p0", "p1", "p2", "p3")
    pred = F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).when(F.col("p2") == top, 2).otherwise(3)
    return v.probs().withColumn("pred", pred).withColumn("conf", top)


H = "('0x'||substr(md5({x}),1,8))::UBIGINT/4294967295.0"


@query(
    "f12_baselines",
    "SELECT id, 1 AS neutral, (u >= c0)::INT + (u >= c1)::INT + (u >= c2)::INT AS freq, CASE WHEN p0-p1 > 0.1 THEN 2 WHEN p0-p1 < -0.1 THEN 0 ELSE 1 END AS sent FROM (SELECT id, p0, p1, "
    + H.format(x="concat_ws('|','42',CAST(id AS VARCHAR))") + " AS u FROM probs_v), (SELECT avg((y=0)::INT) AS c0, avg((y<=1)::INT) AS c1, avg((y<=2)::INT) AS c2 FROM probs_v)",
)
def f12(v):
    p = v.probs()
    f = L.frequency_random(p, p, "y", "id", "42", out="freq").withColumn("neutral", F.lit(1))
    return f.select("id", "neutral", "freq", L.sentiment_rule(F.col("p0") - F.col("p1"), cut=0.1).alias("sent"))


PC = (
    "SELECT k AS class_id, coalesce(tp/nullif(pp,0),0) AS precision, coalesce(tp/nullif(sup,0),0) AS recall, coalesce(2*tp/nullif(pp+sup,0),0) AS f1, sup AS support FROM (SELECT k, count(*) FILTER (y=k AND pred=k)::DOUBLE AS tp, count(*) FILTER (pred=k) AS pp, count(*) FILTER (y=k) AS sup "
    "FROM pred_v CROSS JOIN (VALUES (0),(1),(2),(3)) c(k) GROUP BY 1)"
)


@query("f13_per_class_report", "SELECT class_id, round(precision,9) AS precision, round(recall,9) AS recall, round(f1,9) AS f1, support FROM pc_v", pred_v=PRED, pc_v=PC)
def f13(v):
    return L.per_class_report(predicted(v), "y", "pred").select("class_id", r("precision"), r("recall"), r("f1"), "support")


@query("f13_summary", "SELECT round(avg((y=pred)::INT),9) AS accuracy, round(avg(abs(y-pred)),9) AS ordinal_mae, round((SELECT avg(f1) FROM pc_v),9) AS macro_f1 FROM pred_v", pred_v=PRED, pc_v=PC)
def f13s(v):
    return L.classification_summary(predicted(v), "y", "pred").select(r("accuracy"), r("ordinal_mae"), r("macro_f1"))


@query("f14_confusion_matrix", "SELECT y AS actual, count(*) FILTER (pred=0) AS pred_0, count(*) FILTER (pred=1) AS pred_1, count(*) FILTER (pred=2) AS pred_2, count(*) FILTER (pred=3) AS pred_3 FROM pred_v GROUP BY 1", pred_v=PRED)
def f14(v):
    return L.confusion_matrix(predicted(v), "y", "pred")


@query("f15_wrong_direction", "SELECT y AS actual, count(*) AS n, count(*) FILTER (pred=0) AS n_wrong, round(avg((pred=0)::INT),9) AS wrong_rate FROM pred_v WHERE y IN (2,3) GROUP BY 1", pred_v=PRED)
def f15(v):
    return L.wrong_direction(predicted(v), "y", "pred").select("actual", "n", "n_wrong", r("wrong_rate"))


@query("f16_confidence_deciles", "SELECT bin, count(*) AS n, round(avg(conf),8) AS mean_pred, round(avg((y=pred)::INT),9) AS emp_freq FROM (SELECT *, ntile(10) OVER (ORDER BY conf, id) AS bin FROM pred_v) GROUP BY 1", pred_v=PRED)
def f16(v):
    return L.reliability(predicted(v), "conf", F.col("y") == F.col("pred"), "id", 10).select("bin", "n", r("mean_pred", 8), r("emp_freq"))


CURVE = (
    "SELECT g/100.0::DOUBLE AS threshold, (sum(n) OVER w)::BIGINT AS fired, (sum(h) OVER w)/(sum(n) OVER w)::DOUBLE AS precision, (sum(h) OVER w)/(sum(h) OVER ())::DOUBLE AS recall, (sum(n) OVER w)/(sum(n) OVER ())::DOUBLE AS fire_rate FROM "
    "(SELECT floor(round(p3*100,9))::INT AS g, count(*) AS n, count(*) FILTER (y=3) AS h FROM probs_v GROUP BY 1) WINDOW w AS (ORDER BY g DESC)"
)


@query("f19_threshold_curve", "SELECT threshold, fired, round(precision,9) AS precision, round(recall,9) AS recall, round(fire_rate,9) AS fire_rate FROM curve_v", curve_v=CURVE)
def f19(v):
    return L.threshold_curve(v.probs(), "p3", F.col("y") == 3, 0.01).select("threshold", "fired", r("precision"), r("recall"), r("fire_rate"))


EXACT_CURVE = (
    "SELECT p3 AS threshold, (sum(n) OVER w)::BIGINT AS fired, (sum(h) OVER w)/(sum(n) OVER w)::DOUBLE AS precision, (sum(h) OVER w)/(sum(h) OVER ())::DOUBLE AS recall, (sum(n) OVER w)/(sum(n) OVER ())::DOUBLE AS fire_rate FROM "
    "(SELECT p3, count(*) AS n, count(*) FILTER (y=3) AS h FROM probs_v GROUP BY 1) WINDOW w AS (ORDER BY p3 DESC)"
)


@query("f19_exact_curve", "SELECT round(threshold,9) AS threshold, fired, round(precision,9) AS precision, round(recall,9) AS recall, round(fire_rate,9) AS fire_rate FROM curve_v", curve_v=EXACT_CURVE)
def f19x(v):
    """Every distinct probability as a threshold."""
    c = L.threshold_curve(v.probs(), "p3", F.col("y") == 3)
    return c.select(r("threshold"), "fired", r("precision"), r("recall"), r("fire_rate"))


@query("f19_choose_threshold", "SELECT threshold, fired, round(precision,9) AS precision, round(recall,9) AS recall, round(fire_rate,9) AS fire_rate FROM curve_v WHERE precision >= 0.45 AND fire_rate BETWEEN 0.01 AND 0.05 ORDER BY threshold LIMIT 1", curve_v=CURVE)
def f19c(v):
    c = L.choose_threshold(L.threshold_curve(v.probs(), "p3", F.col("y") == 3, 0.01), P.PRECISION_FLOOR["Strong Buy"])
    return c.select("threshold", "fired", r("precision"), r("recall"), r("fire_rate"))


@query("f19_choose_exact_threshold", "SELECT round(threshold,9) AS threshold, fired, round(precision,9) AS precision, round(recall,9) AS recall, round(fire_rate,9) AS fire_rate FROM curve_v WHERE precision >= 0.45 AND fire_rate BETWEEN 0.01 AND 0.05 ORDER BY curve_v.threshold LIMIT 1", curve_v=EXACT_CURVE)
def f19cx(v):
    """The choice among all distinct probabilities."""
    c = L.choose_threshold(L.threshold_curve(v.probs(), "p3", F.col("y") == 3), P.PRECISION_FLOOR["Strong Buy"])
    return c.select(r("threshold"), "fired", r("precision"), r("recall"), r("fire_rate"))


@query("f20_reliability", "SELECT bin, count(*) AS n, round(avg(p2),8) AS mean_pred, round(avg((y=2)::INT),9) AS emp_freq FROM (SELECT *, ntile(5) OVER (ORDER BY p2, id) AS bin FROM probs_v) GROUP BY 1")
def f20(v):
    return L.reliability(v.probs(), "p2", F.col("y") == 2, "id", 5).select("bin", "n", r("mean_pred", 8), r("emp_freq"))


THR = {"Strong Buy": 0.45, "Buy": 0.42, "Sell": 0.4}
DEC = (
    "SELECT id, ticker, ts, value, CASE WHEN p3 >= 0.45 OR p2 >= 0.42 THEN 'fired' ELSE 'silent' END AS status, CASE WHEN p3 >= 0.45 THEN 'Strong Buy' WHEN p2 >= 0.42 THEN 'Buy' ELSE "
    f"CASE {ARG} WHEN 0 THEN 'Sell' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Buy' ELSE 'Strong Buy' END END AS class_name, CASE WHEN p3 >= 0.45 THEN p3 WHEN p2 >= 0.42 THEN p2 ELSE greatest(p0,p1,p2,p3) END AS prob_calibrated FROM probs_v"
)


def decisions(v):
    return L.decide(v.probs(), ["p0", "p1", "p2", "p3"], THR)


@query("f21_decide", "SELECT id, status, class_name, round(prob_calibrated,9) AS prob_calibrated FROM dec_v", dec_v=DEC)
def f21(v):
    return decisions(v).select("id", "status", "class_name", r("prob_calibrated"))


@query(
    "f22_final_status",
    "SELECT id, CASE WHEN ca THEN 'silent' ELSE status END AS status, (CASE WHEN class_name='Sell' THEN sev <= -1.4308 WHEN class_name IN ('Buy','Strong Buy') THEN sev >= 1.48 ELSE false END)::INT AS severe, "
    "CASE WHEN ca THEN 'corporate_action' WHEN status='fired' THEN '' WHEN class_name='Sell' THEN 'sell_side_suppressed' ELSE 'below_threshold' END AS suppress_reason FROM (SELECT *, value/50 - 1.5 AS sev, ticker='error' AND ts < TIMESTAMP '2024-01-10' AS ca FROM dec_v)",
    dec_v=DEC,
)
def f22(v):
    d = decisions(v).withColumn("sev", F.col("value") / 50 - 1.5).withColumn("ca", (F.col("ticker") == "error") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp")))
    return L.finalize_decision(d, "sev", F.lit(-1.4308), F.lit(1.48), "ca").select("id", "status", "severe", "suppress_reason")


@query(
    "f25_feature_parity",
    "SELECT ticker, count(DISTINCT id) AS n, round(max(rel),9) AS max_rel_diff, arg_max(f, (rel, -length(f), f)) AS worst_feature, CASE WHEN max(rel) < 1e-6 THEN 'OK' WHEN max(rel) < 1e-3 THEN '~' ELSE 'DIFF' END AS flag FROM ("
    "SELECT id, ticker, 'value' AS f, CASE WHEN id % 97 = 0 THEN 0.0004/greatest(abs(value),1e-12) ELSE 0 END AS rel FROM probs_v UNION ALL SELECT id, ticker, 'p00', 0.0 FROM probs_v) GROUP BY 1",
)
def f25(v):
    a = v.probs().select("id", "ticker", "value", F.col("p0").alias("p00"))
    b = a.withColumn("value", F.col("value"))
    a = a.withColumn("value", F.when(F.col("id") % 97 == 0, F.col("value") + 0.0004).otherwise(F.col("value")))
    return L.parity(a, b, "id", ["value", "p00"], "ticker").select("ticker", "n", r("max_rel_diff"), "worst_feature", "flag")


@query("f26_random_row_per_key", "SELECT ticker, arg_min(signal_id, (h, signal_id)) AS signal_id FROM (SELECT ticker, signal_id, ('0x'||substr(md5(concat_ws('|','3',CAST(signal_id AS VARCHAR))),1,8))::UBIGINT AS h FROM signals_v) GROUP BY 1")
def f26(v):
    return L.random_row_per_key(v.signals().select("ticker", "signal_id"), "ticker", "signal_id", "3")
