"""Registered queries: model fitting, calibration and severity.

Fitted trees are rows-only checks; what is computed from given scores, predictions or importances has an oracle.
"""

from pyspark.sql import functions as F

from tidemark.operators import additive as N
from tidemark.operators import isotonic as I
from tidemark.operators import labels as L
from tidemark.operators import models as M
from tidemark.operators import reports as R
from tidemark.plans.registry import query

FEATURES = ["p0", "p1", "p2", "p3", "hour", "dow"]
GROUPS = {"p0": "score", "p1": "score", "p2": "score", "p3": "score", "hour": "clock", "dow": "clock"}
CUT = "2024-01-22"


def frame(v):
    """Model rows: class scores and clock features, truth `y`, severity target `score`."""
    p = v.probs().withColumn("hour", F.hour("ts")).withColumn("dow", F.dayofweek("ts")).withColumn("score", F.ln("value") - 3)
    return v.keep(L.holdout_split(p, "ts", F.lit(CUT).cast("timestamp")))


def split(v):
    f = frame(v)
    return f.filter("part = 'train'"), f.filter("part = 'test'")


def folds(v, train):
    return v.keep(L.walk_forward_folds(train, "ts", initial_days=8))


@query("f9_grid_search")
def f9(v):
    train, _ = split(v)
    return M.grid_search(train, "ts", folds(v, train), FEATURES, "y", [{"trees": 5, "depth": 3}, {"trees": 5, "depth": 5}])


@query("f11_classifier")
def f11(v):
    train, test = split(v)
    model = M.fit_classifier(train, FEATURES, "y", lambda: M.forest(10, 5))
    return M.predict_probs(model, test, FEATURES).select("id", "y", "pred", "q0", "q1", "q2", "q3")


# ---- the additive model ------------------------------------------------------------------------------
DAY = "CAST(ts AS DATE)"
NB = {
    "fr_v": f"SELECT id, ts, {DAY} AS day, y, p0, p1, p2, p3, hour(ts)::DOUBLE AS hour, (dayofweek(ts) + 1)::DOUBLE AS dow FROM probs_v",
    "ho_v": f"SELECT 1 AS fold, DATE '{CUT}' AS test_start, (SELECT max(day) FROM fr_v) AS test_end, DATE '{CUT}' - 1 AS train_before",
    "tr_v": f"SELECT * FROM fr_v WHERE day < DATE '{CUT}' - 1",
    "wf_v": "SELECT fold, min(day) AS test_start, max(day) AS test_end, min(day) - 1 AS train_before FROM (SELECT day, ntile(3) OVER (ORDER BY day) AS fold FROM (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM tr_v)) WHERE i > 8) GROUP BY 1",
}


def nb_views(rows: str, folds: str, trials: str = "(VALUES (0, 1e-9, true)) t(trial, smoothing, balanced)") -> dict[str, str]:
    """Naive Bayes in long form: one row per feature, two-pass variances per fold and class."""
    unpivot = "UNPIVOT {} ON p0, p1, p2, p3, hour, dow INTO NAME f VALUE x"
    return {
        **NB,
        "in_v": f"SELECT g.fold, r.* FROM {rows} r JOIN {folds} g ON r.day < g.train_before",
        "te_v": f"SELECT g.fold, r.* FROM {rows} r JOIN {folds} g ON r.day BETWEEN g.test_start AND g.test_end",
        "il_v": f"SELECT fold, y, f, x FROM ({unpivot.format('in_v')})",
        "tl_v": f"SELECT fold, id, y, f, x FROM ({unpivot.format('te_v')})",
        "po_v": "SELECT fold, f, var_pop(x) AS v FROM il_v GROUP BY 1,2",
        "cl_v": "SELECT c.fold, c.y AS k, t.trial, CASE WHEN t.balanced THEN -ln(count(*) OVER (PARTITION BY c.fold, t.trial)) ELSE ln(c.n / sum(c.n) OVER (PARTITION BY c.fold, t.trial)) END AS prior "
        f"FROM (SELECT fold, y, count(*) AS n FROM in_v GROUP BY 1,2) c, {trials}",
        "pa_v": f"SELECT l.fold, l.y AS k, l.f, t.trial, avg(l.x) AS m, var_pop(l.x) + t.smoothing * any_value(p.v) AS v FROM il_v l JOIN po_v p ON p.fold=l.fold AND p.f=l.f, {trials} WHERE p.v > 0 GROUP BY 1,2,3,4, t.smoothing",
        "ll_v": "SELECT l.trial, l.fold, l.id, l.y, l.k, l.s + c.prior AS s FROM (SELECT p.trial, t.fold, t.id, t.y, p.k, sum(-(ln(p.v) + (t.x-p.m)*(t.x-p.m)/p.v)/2) AS s FROM tl_v t JOIN pa_v p ON p.fold=t.fold AND p.f=t.f GROUP BY 1,2,3,4,5) l JOIN cl_v c ON c.fold=l.fold AND c.k=l.k AND c.trial=l.trial",
        "sm_v": "SELECT trial, fold, id, y, k, exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w AS q, row_number() OVER (PARTITION BY trial, fold, id ORDER BY s DESC, k) AS r FROM (SELECT *, max(s) OVER (PARTITION BY trial, fold, id) AS m FROM ll_v) WINDOW w AS (PARTITION BY trial, fold, id)",
        "nb_v": "SELECT trial, fold, id, any_value(y) AS y, max(CASE WHEN r=1 THEN k END) AS pred, " + ", ".join(f"coalesce(max(CASE WHEN k={k} THEN q END),0) AS q{k}" for k in range(4)) + " FROM sm_v GROUP BY 1,2,3",
    }


Q = ", ".join(f"round(q{k},7) AS q{k}" for k in range(4))


def rounded(df, *first):
    return df.select(*first, *[F.round(f"q{k}", 7).alias(f"q{k}") for k in range(4)])


@query("f11_additive_classifier", f"SELECT id, y, pred, {Q} FROM nb_v", **nb_views("fr_v", "ho_v"))
def f11a(v):
    """Naive Bayes on the holdout split."""
    train, test = split(v)
    return rounded(N.holdout(train, test, FEATURES, "y"), "id", "y", "pred")


@query("f17_additive_out_of_fold", f"SELECT id, fold, y, pred, {Q} FROM nb_v", **nb_views("tr_v", "wf_v"))
def f17a(v):
    """Naive Bayes out of fold: all expanding folds from one pass over the rows."""
    train, _ = split(v)
    return rounded(N.out_of_fold(train, "ts", folds(v, train), FEATURES, "y"), "id", "fold", "y", "pred")


GRID = [(1e-9, True), (1e-9, False), (0.1, True), (1.0, False)]
TRIALS = "(VALUES " + ", ".join(f"({i}, {s}, {str(b).lower()})" for i, (s, b) in enumerate(GRID)) + ") t(trial, smoothing, balanced)"


@query(
    "f9_additive_search",
    "SELECT m.trial, round(avg(m.f),8) AS value, any_value(t.smoothing)::DOUBLE AS smoothing, any_value(t.balanced) AS balanced FROM (SELECT trial, fold, avg(f1) AS f FROM (SELECT a.trial, a.fold, a.k, 2.0*a.tp/(a.n+a.p) AS f1 FROM "
    "(SELECT n.trial, n.fold, k.k, count(*) FILTER (n.y=k.k) AS n, count(*) FILTER (n.pred=k.k) AS p, count(*) FILTER (n.y=k.k AND n.pred=k.k) AS tp FROM nb_v n, (VALUES (0),(1),(2),(3)) k(k) GROUP BY 1,2,3) a WHERE a.n > 0) GROUP BY 1,2) m "
    f"JOIN {TRIALS} ON t.trial=m.trial GROUP BY 1",
    **nb_views("tr_v", "wf_v", TRIALS),
)
def f9a(v):
    """Four trials over all folds from the same sums."""
    train, _ = split(v)
    s = N.search(train, "ts", folds(v, train), FEATURES, "y", GRID)
    return s.select("trial", F.round("value", 8).alias("value"), "smoothing", "balanced")


def calibrated(v):
    train, _ = split(v)
    oof = v.keep(M.out_of_fold(train, "ts", folds(v, train), FEATURES, "y", lambda: M.forest(5, 4)))
    return oof, M.fit_isotonic(oof, "y", ["q0", "q1", "q2", "q3"])


@query("f17_out_of_fold")
def f17(v):
    train, _ = split(v)
    oof = M.out_of_fold(train, "ts", folds(v, train), FEATURES, "y", lambda: M.forest(5, 4))
    return oof.select("id", "fold", "y", "pred", "q0", "q1", "q2", "q3")


@query("f18_isotonic_calibration")
def f18(v):
    oof, iso = calibrated(v)
    return M.calibrate(oof, iso, ["q0", "q1", "q2", "q3"]).select("id", "c0", "c1", "c2", "c3")


# Pool-adjacent-violators in closed form: the greatest, over starts up to a point, of the least mean up to any later end.
ISO = {
    "u_v": "SELECT id, y, round(p0,2) AS a0, round(p1,2) AS a1, round(p2,2) AS a2, round(p3,2) AS a3 FROM probs_v",
    "g_v": " UNION ALL ".join(f"SELECT {k} AS k, a{k} AS x, sum((y={k})::INT)::DOUBLE AS s, count(*)::DOUBLE AS w FROM u_v GROUP BY a{k}" for k in range(4)),
    "c_v": "SELECT *, row_number() OVER o AS i, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM g_v WINDOW o AS (PARTITION BY k ORDER BY x)",
    "m_v": "SELECT k, x, max(lo) AS c FROM (SELECT q.k, q.x, a.i, min((b.cs-a.cs+a.s)/(b.cw-a.cw+a.w)) AS lo FROM c_v q JOIN c_v a ON a.k=q.k AND a.i <= q.i JOIN c_v b ON b.k=q.k AND b.i >= q.i GROUP BY 1,2,3) GROUP BY 1,2",
    "r_v": "SELECT id, m0.c AS r0, m1.c AS r1, m2.c AS r2, m3.c AS r3, m0.c+m1.c+m2.c+m3.c AS t FROM u_v " + " ".join(f"JOIN m_v m{k} ON m{k}.k={k} AND m{k}.x=a{k}" for k in range(4)),
}


@query("f18_isotonic_on_scores", "SELECT id, " + ", ".join(f"round(r{k}/CASE WHEN t=0 THEN 1 ELSE t END,8) AS c{k}" for k in range(4)) + " FROM r_v", **ISO)
def f18s(v):
    """Isotonic maps of given scores (two digits), fitted and applied."""
    p = v.keep(v.probs().select("id", "y", *[F.round(f"p{k}", 2).alias(f"a{k}") for k in range(4)]))
    a = [f"a{k}" for k in range(4)]
    return M.calibrate(p, M.fit_isotonic(p, "y", a), a).select("id", *[F.round(f"c{k}", 8).alias(f"c{k}") for k in range(4)])


CAL = "SELECT id, " + ", ".join(f"round(r{k}/CASE WHEN t=0 THEN 1 ELSE t END,8) AS c{k}" for k in range(4)) + " FROM r_v"


@query("f18_isotonic_steps", CAL, **ISO)
def f18t(v):
    """The same maps fitted in blocks and applied by an as-of join."""
    p = v.keep(v.probs().select("id", "y", *[F.round(f"p{k}", 2).alias(f"a{k}") for k in range(4)]))
    a = [f"a{k}" for k in range(4)]
    return I.apply(p, I.fit(p, "y", a), a, "id").select("id", *[F.round(f"c{k}", 8).alias(f"c{k}") for k in range(4)])


# The whole chain: additive model out of fold, then maps of its probabilities (two digits).
OOF = {
    **nb_views("tr_v", "wf_v"),
    **ISO,
    "u_v": "SELECT id, y, " + ", ".join(f"round(q{k},2) AS a{k}" for k in range(4)) + " FROM nb_v",
}


def oof_scores(v):
    train, _ = split(v)
    oof = N.out_of_fold(train, "ts", folds(v, train), FEATURES, "y")
    return v.keep(oof.select("id", "y", *[F.round(f"q{k}", 2).alias(f"a{k}") for k in range(4)]))


@query("f18_isotonic_out_of_fold", CAL, **OOF)
def f18o(v):
    """Calibration of the additive model's out-of-fold probabilities."""
    p, a = oof_scores(v), [f"a{k}" for k in range(4)]
    return I.apply(p, I.fit(p, "y", a), a, "id").select("id", *[F.round(f"c{k}", 8).alias(f"c{k}") for k in range(4)])


@query(
    "j26_fitted_map_shape",
    "SELECT k AS class_id, sum(CASE WHEN n=1 THEN 1 ELSE 2 END)::BIGINT AS n_breakpoints, round(min(c),9) AS min_out, round(max(c),9) AS max_out, count(*) FILTER (n > 1) AS n_flat FROM (SELECT k, c, count(*) AS n FROM m_v GROUP BY 1,2) GROUP BY 1",
    **OOF,
)
def j26f(v):
    """Shape of the maps fitted out of fold."""
    s = R.calibration_shape(I.breakpoints(I.fit(oof_scores(v), "y", [f"a{k}" for k in range(4)])))
    return s.select("class_id", "n_breakpoints", F.round("min_out", 9).alias("min_out"), F.round("max_out", 9).alias("max_out"), "n_flat")


@query(
    "f23_prediction_metrics",
    "SELECT round(avg(abs(s-p)),8) AS mae, count(*) FILTER (p <= -0.5) AS n_low, round(avg((s <= -0.5)::INT) FILTER (p <= -0.5),9) AS low_hit, count(*) FILTER (p >= 0.5) AS n_high, round(avg((s >= 0.5)::INT) FILTER (p >= 0.5),9) AS high_hit, round(corr(rp, rs),8) AS spearman FROM "
    "(SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2.0::DOUBLE AS rp, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2.0::DOUBLE AS rs FROM (SELECT p3*4-1 AS p, ln(value)-3 AS s FROM probs_v))",
)
def f23p(v):
    """Severity metrics of given predictions."""
    p = v.probs().select((F.ln("value") - 3).alias("s"), (F.col("p3") * 4 - 1).alias("pred_score"))
    m = M.prediction_metrics(p, -0.5, 0.5)
    return m.select(*[F.round(c, 9 if "hit" in c else 8).alias(c) if c[0] != "n" else c for c in ("mae", "n_low", "low_hit", "n_high", "high_hit", "spearman")])


@query(
    "f24_group_shares",
    "SELECT feature, grp, round(i,9) AS importance, round(sum(i) OVER (PARTITION BY grp)/sum(i) OVER (),9) AS group_share FROM (SELECT ticker AS feature, substr(ticker,1,1) AS grp, avg(p3) AS i FROM probs_v GROUP BY 1)",
)
def f24g(v):
    """Group shares of given importances."""
    t = v.probs().groupBy(F.col("ticker").alias("feature")).agg(F.substring(F.first("ticker"), 1, 1).alias("grp"), F.avg("p3").alias("importance"))
    return M.with_group_share(t).select("feature", "grp", F.round("importance", 9).alias("importance"), F.round("group_share", 9).alias("group_share"))


@query("j26_calibration_map_shape")
def j26(v):
    oof, iso = calibrated(v)
    return R.calibration_shape(M.calibration_steps(oof, iso))


@query("f23_severity")
def f23(v):
    train, test = split(v)
    model = M.fit_severity(train, FEATURES, "score", 5, 3)
    return M.severity_metrics(model, test, FEATURES, "score", -1.0, 1.0)


@query("f24_importances")
def f24(v):
    train, _ = split(v)
    model = M.fit_classifier(train, FEATURES, "y", lambda: M.forest(10, 5))
    return M.importances(model, train, FEATURES, GROUPS)
