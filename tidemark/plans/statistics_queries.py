"""Registered queries: clustered statistics, matched baselines and resampling."""

from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import align as A
from tidemark.operators import features as E
from tidemark.operators import stats as S
from tidemark.plans.features_queries import B, POP
from tidemark.plans.filings_queries import SV as FV
from tidemark.plans.filings_queries import events as purchase_events
from tidemark.plans.filings_queries import scored
from tidemark.plans.registry import query


def r(c, n=9, name=None):
    return F.round(c, n).alias(name or c)


def boot(cells: str, keys: str, m: str, n_boot: int, seed: str, order: str, sel: str) -> str:
    """Percentiles of `m` over hash-indexed resamples of the cluster table `cells`."""
    k = [x for x in keys.split(",") if x]
    part = f"PARTITION BY {keys}" if k else ""
    on = " AND ".join(f"c.{x}=d.{x}" for x in k)
    return (
        f"SELECT {keys + ', ' if k else ''}{sel} FROM (SELECT {', '.join('d.' + x for x in k) + ', ' if k else ''}d.b, {m} AS m FROM (SELECT {keys + ', ' if k else ''}b, i, ('0x'||substr(md5(concat_ws('|','{seed}',b,i)),1,8))::UBIGINT::BIGINT % mm AS j FROM "
        f"(SELECT {keys + ', ' if k else ''}mm, b, unnest(range(mm)) AS i FROM (SELECT {keys + ', ' if k else ''}count(*) AS mm FROM {cells} {'GROUP BY ' + keys if k else ''}) CROSS JOIN range({n_boot}) t(b))) d "
        f"JOIN (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS j FROM {cells}) c ON c.j=d.j {'AND ' + on if k else ''} GROUP BY {', '.join('d.' + x for x in k) + ', ' if k else ''}d.b) {'GROUP BY ' + keys if k else ''}"
    )


CELLS = "SELECT ticker, day, sum(net_ret) AS c_sum, count(*) AS c_n, avg(net_ret) AS c_mean, count(*) FILTER (net_ret < 0) AS c_neg FROM trades_v GROUP BY 1,2"
PCT = "round(quantile_cont(m,0.025),8) AS lo, round(quantile_cont(m,0.975),8) AS hi"


@query(
    "h1_cluster_stats",
    "SELECT ticker, sum(c_n)::BIGINT AS n, count(*) AS n_clusters, round(sum(c_sum)/sum(c_n),9) AS pooled_mean, round(avg(c_mean),9) AS cluster_mean, round(avg(c_mean)/(stddev_samp(c_mean)/sqrt(count(*))),6) AS t, round(avg(c_n),9) AS rows_per_cluster FROM cells_v GROUP BY 1",
    cells_v=CELLS,
)
def h1(v):
    s = S.cluster_stats(v.trades(), ["ticker"], "day", "net_ret")
    return s.select("ticker", "n", "n_clusters", r("pooled_mean"), r("cluster_mean"), r("t", 6), r("rows_per_cluster"))


@query("h2_cluster_bootstrap", boot("cells_v", "ticker", "avg(c.c_mean)", 200, "42", "day", PCT + ", round(avg((m<=0)::INT),9) AS p_le_0"), cells_v=CELLS)
def h2(v):
    return S.cluster_bootstrap(v.trades(), ["ticker"], "day", "net_ret", 200, "42").select("ticker", r("lo", 8), r("hi", 8), r("p_le_0"))


@query(
    "h3_summary_rows",
    "SELECT c.ticker, sum(c_n)::BIGINT AS n, count(*) AS n_days, round(avg(c_mean),9) AS day_mean, round(sum(c_sum)/sum(c_n),9) AS pooled, round(sum(c_neg)/sum(c_n),9) AS neg_share, sum(c_n) < 30 AS thin, any_value(b.lo) AS lo, any_value(b.hi) AS hi FROM cells_v c JOIN b_v b ON b.ticker=c.ticker GROUP BY 1",
    cells_v=CELLS, b_v=boot("cells_v", "ticker", "avg(c.c_mean)", 200, "42", "day", PCT),
)
def h3(v):
    s = S.summarize(v.trades(), ["ticker"], "day", "net_ret", 200, "42")
    return s.select("ticker", "n", "n_days", r("day_mean"), r("pooled"), r("neg_share"), "thin", r("lo", 8), r("hi", 8))


RV = {
    "w_v": "SELECT signal_id, ticker, CAST(ts_utc AS DATE) AS day, ts_utc AS t0, ts_utc + INTERVAL '120' MINUTE AS t1 FROM signals_v WHERE status='fired'",
    "r_v": "SELECT w.t0, u.ticker, CASE WHEN z.ts >= a.ts THEN z.close/a.open - 1 END AS ret FROM (SELECT DISTINCT t0, t1 FROM w_v) w CROSS JOIN universe_v u ASOF LEFT JOIN bars_v a ON a.ticker=u.ticker AND a.ts >= w.t0 ASOF LEFT JOIN bars_v z ON z.ticker=u.ticker AND z.ts < w.t1",
    "adj_v": "SELECT r.t0, r.ticker, r.ret - b.ret AS adj FROM r_v r JOIN r_v b ON b.t0=r.t0 AND b.ticker='view'",
    "draw_v": (
        "SELECT b, avg(dm) AS draw_mean FROM (SELECT b, day, avg(v[('0x'||substr(md5(concat_ws('|','7',b,signal_id)),1,8))::UBIGINT::BIGINT % len(v) + 1]) AS dm FROM (SELECT w.signal_id, w.day, list(a.adj ORDER BY a.ticker) AS v FROM w_v w JOIN adj_v a ON a.t0=w.t0 WHERE a.adj IS NOT NULL AND a.ticker <> w.ticker GROUP BY 1,2) "
        "CROSS JOIN range(100) t(b) GROUP BY 1,2) GROUP BY 1"
    ),
}


def control(v):
    s = v.signals().filter("status = 'fired'").select("signal_id", "ticker", F.to_date("ts_utc").alias("day"), F.col("ts_utc").alias("t0"), A.after("ts_utc", 120).alias("t1"))
    rets = A.universe_returns(s, v.bars(), v.universe(), "view")
    return s, rets, S.random_ticker_control(s, rets, ["t0", "t1"], 100, "7")


@query("h4_random_ticker_draws", "SELECT b::INT AS b, round(draw_mean,7) AS draw_mean FROM draw_v", **RV)
def h4(v):
    return control(v)[2].select("b", r("draw_mean", 7))


@query(
    "h4_control_percentile",
    "SELECT round(m,7) AS real_mean, round(avg(CASE WHEN draw_mean < m THEN 1.0 WHEN draw_mean = m THEN 0.5 ELSE 0 END),9) AS real_percentile, round(quantile_cont(draw_mean,0.5),7) AS control_median FROM draw_v, (SELECT avg(dm) AS m FROM (SELECT w.day, avg(a.adj) AS dm FROM w_v w JOIN adj_v a ON a.t0=w.t0 AND a.ticker=w.ticker WHERE a.adj IS NOT NULL GROUP BY 1)) GROUP BY m",
    **RV,
)
def h4p(v):
    s, rets, draws = control(v)
    real = S.cluster_stats(s.join(rets, ["t0", "t1", "ticker"]), [], "day", "adj").select("cluster_mean").scalar()
    return S.control_percentile(draws, real).select(r("real_mean", 7), r("real_percentile"), r("control_median", 7))


# Both groups of the report: all signals, and the fired ones among them.
RG = {
    "w_v": "SELECT unnest(CASE WHEN status='fired' THEN ['all','fired'] ELSE ['all'] END) AS grp, signal_id, ticker, CAST(ts_utc AS DATE) AS day, ts_utc AS t0, ts_utc + INTERVAL '120' MINUTE AS t1 FROM signals_v",
    "r_v": RV["r_v"],
    "adj_v": RV["adj_v"],
    "draw_v": (
        "SELECT grp, b, avg(dm) AS draw_mean FROM (SELECT grp, b, day, avg(v[('0x'||substr(md5(concat_ws('|','7',b,signal_id)),1,8))::UBIGINT::BIGINT % len(v) + 1]) AS dm FROM (SELECT w.grp, w.signal_id, w.day, list(a.adj ORDER BY a.ticker) AS v FROM w_v w JOIN adj_v a ON a.t0=w.t0 WHERE a.adj IS NOT NULL AND a.ticker <> w.ticker GROUP BY 1,2,3) "
        "CROSS JOIN range(100) t(b) GROUP BY 1,2,3) GROUP BY 1,2"
    ),
}


def control_groups(v):
    s = v.signals().select(
        F.explode(F.when(F.col("status") == "fired", F.array(F.lit("all"), F.lit("fired"))).otherwise(F.array(F.lit("all")))).alias("grp"),
        "signal_id", "ticker", F.to_date("ts_utc").alias("day"), F.col("ts_utc").alias("t0"), A.after("ts_utc", 120).alias("t1"),
    )
    rets = v.keep(A.universe_returns(s, v.bars(), v.universe(), "view"))
    return s, rets, S.random_ticker_control(s, rets, ["t0", "t1"], 100, "7", by=["grp"])


@query("h4_random_ticker_draws_groups", "SELECT grp, b::INT AS b, round(draw_mean,7) AS draw_mean FROM draw_v", **RG)
def h4g(v):
    """The control of all signals and of the fired ones."""
    return control_groups(v)[2].select("grp", "b", r("draw_mean", 7))


@query(
    "h4_control_percentile_groups",
    "SELECT d.grp, round(m,7) AS real_mean, round(avg(CASE WHEN draw_mean < m THEN 1.0 WHEN draw_mean = m THEN 0.5 ELSE 0 END),9) AS real_percentile, round(quantile_cont(draw_mean,0.5),7) AS control_median, round(quantile_cont(draw_mean,0.025),7) AS control_lo, round(quantile_cont(draw_mean,0.975),7) AS control_hi "
    "FROM draw_v d JOIN (SELECT grp, avg(dm) AS m FROM (SELECT w.grp, w.day, avg(a.adj) AS dm FROM w_v w JOIN adj_v a ON a.t0=w.t0 AND a.ticker=w.ticker WHERE a.adj IS NOT NULL GROUP BY 1,2) GROUP BY 1) x ON x.grp=d.grp GROUP BY d.grp, m",
    **RG,
)
def h4pg(v):
    s, rets, draws = control_groups(v)
    real = S.cluster_stats(s.join(rets, ["t0", "t1", "ticker"]), ["grp"], "day", "adj").select("grp", "cluster_mean")
    p = S.control_percentile(draws.join(real, "grp"), F.col("cluster_mean"), by=["grp"])
    return p.select("grp", r("real_mean", 7), r("real_percentile"), r("control_median", 7), r("control_lo", 7), r("control_hi", 7))


# ---- study statistics --------------------------------------------------------------------------------
SC20 = "SELECT *, strftime(filing_date,'%Y-%m') AS month FROM scored_ev_v WHERE h = 20"
VOL = "SELECT * FROM sc20_v WHERE NOT is_10b5_1 AND adj_ret IS NOT NULL"
VC = "SELECT month, sum(adj_ret) AS c_sum, count(*) AS c_n, avg(adj_ret) AS c_mean FROM vol_v GROUP BY 1"
HV = {**FV, "sc20_v": SC20, "vol_v": VOL, "vc_v": VC}


def voluntary(v, ev=None):
    m = F.date_format("filing_date", "yyyy-MM").alias("month")
    ev = purchase_events(v, settle_owners=False) if ev is None else ev
    return scored(v, ev).filter("h = 20 AND NOT is_10b5_1").select("ticker", "filing_date", "adj_ret", m)


@query(
    "h5_versus_zero",
    "SELECT sum(c_n)::BIGINT AS n, count(*) AS n_months, round(sum(c_sum)/sum(c_n),6) AS mean, round(avg(c_mean)/(stddev_samp(c_mean)/sqrt(count(*))),5) AS t, (SELECT round(quantile_cont(adj_ret,0.5),6) FROM vol_v) AS median, (SELECT round(avg((adj_ret>0)::INT),9) FROM vol_v) AS win, (SELECT lo FROM b_v) AS lo, (SELECT hi FROM b_v) AS hi FROM vc_v",
    **HV, b_v=boot("vc_v", "", "sum(c.c_sum)/sum(c.c_n)", 200, "42", "month", "round(quantile_cont(m,0.025),5) AS lo, round(quantile_cont(m,0.975),5) AS hi"),
)
def h5(v):
    z = S.vs_zero(v.keep(voluntary(v).select("month", "adj_ret")), [], "month", "adj_ret", 200, "42")
    return z.select("n", "n_months", r("mean", 6), r("t", 5), r("median", 6), r("win"), r("lo", 5), r("hi", 5))


ELIG = (
    "SELECT p.ticker, p.d, p.adj_ret_20d AS y, strftime(p.d,'%Y-%m') AS month FROM pop_v p WHERE p.adj_ret_5d IS NOT NULL AND p.d BETWEEN DATE '1993-01-01' AND DATE '2000-12-31' AND NOT EXISTS (SELECT 1 FROM pe_v e WHERE e.ticker=p.ticker AND e.filing_date BETWEEN p.d - 3 AND p.d + 3)"
)
MP = "SELECT p.*, e.n/c.n::DOUBLE AS w FROM (SELECT * FROM elig_v WHERE y IS NOT NULL) p JOIN (SELECT ticker, count(*) AS n FROM vol_v GROUP BY 1) e ON e.ticker=p.ticker JOIN (SELECT ticker, count(*) AS n FROM elig_v WHERE y IS NOT NULL GROUP BY 1) c ON c.ticker=p.ticker"
PV = {**HV, **B, "pop_v": POP, "elig_v": ELIG, "mp_v": MP}


def population(v, ev=None):
    pop = E.population_returns(v.daily(), v.bench(), gap_days=25)
    inside = pop.filter(F.col("d").between(F.lit("1993-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return eligible_population(inside, purchase_events(v) if ev is None else ev)


def both(v):
    """Eligible population and voluntary events of the same purchase events, which are computed once."""
    ev = v.keep(purchase_events(v).select("ticker", "filing_date", "is_10b5_1", "role", "size_bucket", "is_cluster"))
    return population(v, ev), voluntary(v, ev), ev


def population_horizons(v, ev):
    """The eligible population with the return y of every horizon h."""
    pop = E.population_returns(v.daily(), v.bench(), gap_days=25)
    inside = pop.filter(F.col("d").between(F.lit("1993-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    e = A.eligible_days(inside, ev, "d", "filing_date", 3).filter("eligible AND adj_ret_5d IS NOT NULL")
    y = F.inline(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"adj_ret_{h}d").alias("y")) for h in P.STUDY_HORIZONS)))
    return e.select("ticker", "d", F.date_format("d", "yyyy-MM").alias("month"), y)


def eligible_population(inside, events):
    e = A.eligible_days(inside, events, "d", "filing_date", 3).filter("eligible AND adj_ret_5d IS NOT NULL")
    return e.select("ticker", "d", F.col("adj_ret_20d").alias("y"), F.date_format("d", "yyyy-MM").alias("month"))


@query("h8_eligible_population", "SELECT ticker, d, round(y,4) AS y FROM elig_v", **PV)
def h8(v):
    return population(v).select("ticker", "d", r("y", 4))


@query("h7_ticker_mix_weights", "SELECT ticker, count(*) AS n, round(sum(w),6) AS sum_w FROM mp_v GROUP BY 1", **PV)
def h7(v):
    pop, vol, _ = both(v)
    p = S.ticker_mix_weights(pop.filter("y IS NOT NULL"), vol.filter("adj_ret IS NOT NULL"))
    return p.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("sum_w"))


MC = (
    "SELECT coalesce(e.month, p.month) AS month, coalesce(e.w,0) AS e_w, coalesce(e.y,0) AS e_y, coalesce(p.w,0) AS p_w, coalesce(p.y,0) AS p_y FROM (SELECT month, count(*)::DOUBLE AS w, sum(adj_ret) AS y FROM vol_v GROUP BY 1) e FULL JOIN (SELECT month, sum(w) AS w, sum(w*y) AS y FROM mp_v GROUP BY 1) p ON p.month=e.month"
)


@query(
    "h6_weighted_difference",
    "SELECT (SELECT count(*) FROM vol_v) AS n_e, (SELECT count(*) FROM mp_v) AS n_p, G AS \"G\", round(me,5) AS mean_e, round(mp,5) AS mean_p, round(me-mp,5) AS diff, round(sqrt(G/(G-1)*(SELECT sum(power((e_y-e_w*me)/we - (p_y-p_w*mp)/wp,2)) FROM mc_v)),5) AS se, round((me-mp)/sqrt(G/(G-1)*(SELECT sum(power((e_y-e_w*me)/we - (p_y-p_w*mp)/wp,2)) FROM mc_v)),4) AS t, (SELECT lo FROM b_v) AS lo, (SELECT hi FROM b_v) AS hi FROM "
    "(SELECT count(*) AS G, sum(e_w) AS we, sum(p_w) AS wp, sum(e_y)/sum(e_w) AS me, sum(p_y)/sum(p_w) AS mp FROM mc_v)",
    **PV, mc_v=MC, b_v=boot("mc_v", "", "CASE WHEN sum(c.e_w) > 0 AND sum(c.p_w) > 0 THEN sum(c.e_y)/sum(c.e_w) - sum(c.p_y)/sum(c.p_w) END", 200, "7", "month", "round(quantile_cont(m,0.025),4) AS lo, round(quantile_cont(m,0.975),4) AS hi"),
)
def h6(v):
    pop, vol, _ = both(v)
    ev = vol.filter("adj_ret IS NOT NULL")
    p = S.ticker_mix_weights(pop.filter("y IS NOT NULL"), ev)
    t = S.weighted_diff_test(ev.withColumnRenamed("adj_ret", "y"), p, [], "month", "y", "w", 200, "7")
    return t.select("n_e", "n_p", "G", r("mean_e", 5), r("mean_p", 5), r("diff", 5), r("se", 5), r("t", 4), r("lo", 4), r("hi", 4))


CELLQ = (
    "SELECT c AS cell, h, month, ticker, adj_ret FROM (SELECT *, strftime(filing_date,'%Y-%m') AS month, unnest(list_filter(['all', CASE WHEN NOT is_10b5_1 THEN 'voluntary' END, CASE WHEN is_10b5_1 THEN 'planned' END, CASE WHEN NOT is_10b5_1 THEN 'role=' || role END, CASE WHEN NOT is_10b5_1 THEN 'size=' || size_bucket END, "
    "CASE WHEN NOT is_10b5_1 THEN 'cluster=' || is_cluster::VARCHAR END], lambda x: x IS NOT NULL)) AS c FROM scored_ev_v) WHERE adj_ret IS NOT NULL"
)


@query(
    "h9_study_cells",
    "SELECT cell, h, sum(c_n)::BIGINT AS n, count(*) AS n_months, round(sum(c_sum)/sum(c_n),5) AS mean, round(avg(c_mean)/(stddev_samp(c_mean)/sqrt(count(*))),5) AS t FROM (SELECT cell, h, month, sum(adj_ret) AS c_sum, count(*) AS c_n, avg(adj_ret) AS c_mean FROM cell_v GROUP BY 1,2,3) GROUP BY 1,2",
    **FV, cell_v=CELLQ,
)
def h9(v):
    c = S.study_cells(scored(v)).withColumn("month", F.date_format("filing_date", "yyyy-MM"))
    s = S.cluster_stats(c, ["cell", "h"], "month", "adj_ret")
    return s.select("cell", "h", "n", F.col("n_clusters").alias("n_months"), r("pooled_mean", 5, "mean"), r("t", 5))


CELLC = "SELECT cell, h, month, sum(adj_ret) AS c_sum, count(*) AS c_n, avg(adj_ret) AS c_mean FROM cell_v GROUP BY 1,2,3"


@query(
    "h9_cells_versus_zero",
    "SELECT c.cell, c.h, c.n, c.n_months, c.mean, c.t, m.median, m.win, b.lo, b.hi FROM (SELECT cell, h, sum(c_n)::BIGINT AS n, count(*) AS n_months, round(sum(c_sum)/sum(c_n),5) AS mean, round(avg(c_mean)/(stddev_samp(c_mean)/sqrt(count(*))),5) AS t FROM cellc_v GROUP BY 1,2) c "
    "JOIN (SELECT cell, h, round(quantile_cont(adj_ret,0.5),6) AS median, round(avg((adj_ret>0)::INT),9) AS win FROM cell_v GROUP BY 1,2) m ON m.cell=c.cell AND m.h=c.h JOIN b_v b ON b.cell=c.cell AND b.h=c.h",
    **FV, cell_v=CELLQ, cellc_v=CELLC, b_v=boot("cellc_v", "cell,h", "sum(c.c_sum)/sum(c.c_n)", 10000, "42", "month", "round(quantile_cont(m,0.025),5) AS lo, round(quantile_cont(m,0.975),5) AS hi"),
)
def h9z(v):
    """Every cell and horizon against zero."""
    month = F.date_format("filing_date", "yyyy-MM").alias("month")
    one = v.keep(scored(v).filter("adj_ret IS NOT NULL").select("h", month, "adj_ret", "is_10b5_1", "role", "size_bucket", "is_cluster"))
    c = S.study_cells(one).select("cell", "h", "month", "adj_ret")
    z = S.vs_zero(c, ["cell", "h"], "month", "adj_ret", 10000, "42")
    return z.select("cell", "h", "n", "n_months", r("mean", 5), r("t", 5), r("median", 6), r("win"), r("lo", 5), r("hi", 5))


C20 = "SELECT * FROM cell_v WHERE h = 20"
MCC = (
    "SELECT coalesce(e.cell, p.cell) AS cell, coalesce(e.month, p.month) AS month, coalesce(e.w,0) AS e_w, coalesce(e.y,0) AS e_y, coalesce(p.w,0) AS p_w, coalesce(p.y,0) AS p_y FROM (SELECT cell, month, count(*)::DOUBLE AS w, sum(adj_ret) AS y FROM c20_v GROUP BY 1,2) e FULL JOIN "
    "(SELECT k.cell, p.month, sum(k.n/c.n::DOUBLE) AS w, sum(k.n/c.n::DOUBLE*p.y) AS y FROM (SELECT * FROM elig_v WHERE y IS NOT NULL) p JOIN (SELECT cell, ticker, count(*) AS n FROM c20_v GROUP BY 1,2) k ON k.ticker=p.ticker JOIN (SELECT ticker, count(*) AS n FROM elig_v WHERE y IS NOT NULL GROUP BY 1) c ON c.ticker=p.ticker GROUP BY 1,2) p ON p.month=e.month AND p.cell=e.cell"
)


@query(
    "h9_cells_difference",
    "SELECT x.cell, round(me,5) AS mean_e, round(mp,5) AS mean_p, round(me-mp,5) AS diff, round(sqrt(G/(G-1)*sum(power((e_y-e_w*me)/we - (p_y-p_w*mp)/wp,2))),5) AS se FROM mcc_v x JOIN "
    "(SELECT cell, count(*) AS G, sum(e_w) AS we, sum(p_w) AS wp, sum(e_y)/sum(e_w) AS me, sum(p_y)/sum(p_w) AS mp FROM mcc_v GROUP BY 1) t ON t.cell=x.cell GROUP BY x.cell, me, mp, G",
    **{**PV, "cell_v": CELLQ, "c20_v": C20, "mcc_v": MCC},
)
def h9d(v):
    """Every cell at 20 days against the population, weighted to that cell's own mix of tickers."""
    pop, _, ev = both(v)
    c = S.study_cells(scored(v, ev).filter("h = 20 AND adj_ret IS NOT NULL")).withColumn("month", F.date_format("filing_date", "yyyy-MM"))
    events = c.select("cell", "ticker", "month", F.col("adj_ret").alias("y"))
    p = S.cell_mix_weights(pop.filter("y IS NOT NULL"), events, ["cell"], "month", "y")
    t = S.weighted_diff_test(events, p, ["cell"], "month", "y", "w", 50, "7")
    return t.select("cell", r("mean_e", 5), r("mean_p", 5), r("diff", 5), r("se", 5))


ELIGH = ELIG.replace("p.adj_ret_20d AS y", "h.h, CASE h.h WHEN 5 THEN p.adj_ret_5d WHEN 20 THEN p.adj_ret_20d ELSE p.adj_ret_60d END AS y").replace("FROM pop_v p", "FROM pop_v p CROSS JOIN (VALUES (5), (20), (60)) h(h)")
MCH = (
    "SELECT coalesce(e.cell, p.cell) AS cell, coalesce(e.h, p.h) AS h, coalesce(e.month, p.month) AS month, coalesce(e.w,0) AS e_w, coalesce(e.y,0) AS e_y, coalesce(p.w,0) AS p_w, coalesce(p.y,0) AS p_y FROM (SELECT cell, h, month, count(*)::DOUBLE AS w, sum(adj_ret) AS y FROM cell_v GROUP BY 1,2,3) e FULL JOIN "
    "(SELECT k.cell, k.h, p.month, sum(k.n/c.n::DOUBLE) AS w, sum(k.n/c.n::DOUBLE*p.y) AS y FROM (SELECT * FROM eligh_v WHERE y IS NOT NULL) p JOIN (SELECT cell, h, ticker, count(*) AS n FROM cell_v GROUP BY 1,2,3) k ON k.ticker=p.ticker AND k.h=p.h "
    "JOIN (SELECT ticker, h, count(*) AS n FROM eligh_v WHERE y IS NOT NULL GROUP BY 1,2) c ON c.ticker=p.ticker AND c.h=p.h GROUP BY 1,2,3) p ON p.month=e.month AND p.cell=e.cell AND p.h=e.h"
)


@query(
    "h9_cells_difference_horizons",
    "SELECT s.cell, s.h, round(me,5) AS mean_e, round(mp,5) AS mean_p, round(me-mp,5) AS diff, round(se,5) AS se, round(CASE WHEN se > 0 THEN (me-mp)/se END,5) AS t, b.lo, b.hi FROM (SELECT x.cell, x.h, me, mp, sqrt(G/nullif(G-1,0)*sum(power((e_y-e_w*me)/we - (p_y-p_w*mp)/wp,2))) AS se FROM mch_v x JOIN "
    "(SELECT cell, h, count(*) AS G, nullif(sum(e_w),0) AS we, nullif(sum(p_w),0) AS wp, sum(e_y)/nullif(sum(e_w),0) AS me, sum(p_y)/nullif(sum(p_w),0) AS mp FROM mch_v GROUP BY 1,2) t ON t.cell=x.cell AND t.h=x.h GROUP BY x.cell, x.h, me, mp, G) s JOIN b_v b ON b.cell=s.cell AND b.h=s.h",
    **{**PV, "cell_v": CELLQ, "eligh_v": ELIGH, "mch_v": MCH},
    b_v=boot("mch_v", "cell,h", "sum(c.e_y)/nullif(sum(c.e_w),0)-sum(c.p_y)/nullif(sum(c.p_w),0)", 10000, "7", "month", "round(quantile_cont(m,0.025),5) AS lo, round(quantile_cont(m,0.975),5) AS hi"),
)
def h9dh(v):
    """Every cell and horizon against the population of that horizon, weighted to that cell's own mix of tickers."""
    ev = both(v)[2]
    c = S.study_cells(scored(v, ev).filter("adj_ret IS NOT NULL")).withColumn("month", F.date_format("filing_date", "yyyy-MM"))
    events = c.select("cell", "h", "ticker", "month", F.col("adj_ret").alias("y"))
    p = S.cell_mix_weights(population_horizons(v, ev).filter("y IS NOT NULL"), events, ["cell", "h"], "month", "y", shared=["h"])
    t = S.weighted_diff_test(events, p, ["cell", "h"], "month", "y", "w", 10000, "7")
    return t.select("cell", "h", r("mean_e", 5), r("mean_p", 5), r("diff", 5), r("se", 5), r("t", 5), r("lo", 5), r("hi", 5))


@query(
    "h10_wilson_interval",
    "SELECT ticker, round((p + 3.8416/(2*n))/(1+3.8416/n) - 1.96*sqrt(p*(1-p)/n + 3.8416/(4*n*n))/(1+3.8416/n),9) AS lo, round((p + 3.8416/(2*n))/(1+3.8416/n) + 1.96*sqrt(p*(1-p)/n + 3.8416/(4*n*n))/(1+3.8416/n),9) AS hi FROM (SELECT ticker, count(*)::DOUBLE AS n, avg((net_ret>0)::INT) AS p FROM trades_v GROUP BY 1)",
)
def h10(v):
    g = v.trades().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("net_ret") > 0).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("ticker", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query(
    "h11_correlations",
    "SELECT count(*) AS n, round(corr(n_symbols::DOUBLE, entry_price),8) AS pearson, round(corr(rx, ry),8) AS spearman FROM (SELECT *, rank() OVER (ORDER BY n_symbols) + (count(*) OVER (PARTITION BY n_symbols) - 1)/2.0::DOUBLE AS rx, rank() OVER (ORDER BY entry_price) + (count(*) OVER (PARTITION BY entry_price) - 1)/2.0::DOUBLE AS ry FROM signals_v)",
)
def h11(v):
    return S.correlations(v.signals(), "n_symbols", "entry_price").select("n", r("pearson", 8), r("spearman", 8))


DEC = "SELECT bin, count(*) AS n, avg(value) AS mean FROM (SELECT *, ntile(10) OVER (ORDER BY p3, id) AS bin FROM probs_v) GROUP BY 1"


@query("h12_decile_means", "SELECT bin, n, round(mean,7) AS mean FROM dec_v", dec_v=DEC)
def h12(v):
    return S.decile_means(v.probs(), "p3", "value", "id").select("bin", "n", r("mean", 7))


@query("h12_top_minus_bottom", "SELECT round(arg_max(mean,bin) - arg_min(mean,bin),7) AS spread FROM dec_v", dec_v=DEC)
def h12s(v):
    return S.top_minus_bottom(S.decile_means(v.probs(), "p3", "value", "id")).select(r("spread", 7))


@query(
    "h13_value_bands",
    "SELECT CASE WHEN s <= -0.6 THEN '<=-0.6' WHEN s <= -0.2 THEN '-0.6..-0.2' WHEN s <= 0.2 THEN '-0.2..+0.2' WHEN s <= 0.6 THEN '+0.2..+0.6' ELSE '>+0.6' END AS band, count(*) AS n, round(avg((s > -0.05 AND s < 0.05)::INT),9) AS near_zero FROM (SELECT 2*(p0-p1) AS s FROM probs_v) GROUP BY 1",
)
def h13(v):
    b = S.value_bands(v.probs().withColumn("s", 2 * (F.col("p0") - F.col("p1"))), "s")
    return b.select("band", "n", r("near_zero"))


@query(
    "h14_two_constructions",
    "SELECT count(*) AS n_matched, round(avg(abs(p.adj_ret_20d - s.adj_ret)),4) AS mean_abs_diff, round(corr(p.adj_ret_20d, s.adj_ret),5) AS corr FROM vol_v s JOIN pop_v p ON p.ticker=s.ticker AND p.d=s.filing_date WHERE p.adj_ret_20d IS NOT NULL",
    **PV,
)
def h14(v):
    pop = E.population_returns(v.daily(), v.bench(), gap_days=25).withColumnRenamed("d", "filing_date")
    t = S.two_constructions(voluntary(v).select("ticker", "filing_date", "adj_ret"), pop, ["ticker", "filing_date"], "adj_ret", "adj_ret_20d")
    return t.select("n_matched", r("mean_abs_diff", 4), r("corr", 5))


@query(
    "h15_market_decomposition",
    "SELECT role, h, count(*) AS n, round(avg(ret),6) AS raw, round(avg(bench_ret),6) AS benchmark, round(avg(beta*bench_ret),5) AS beta_part, round(avg(ret - beta*bench_ret),5) AS adjusted FROM scored_ev_v GROUP BY 1,2",
    **FV,
)
def h15(v):
    m = S.market_decomposition(scored(v), ["role", "h"], "ret", "bench_ret", "beta")
    return m.select("role", "h", "n", r("raw", 6), r("benchmark", 6), r("beta_part", 5), r("adjusted", 5))


@query(
    "h16_equal_month_difference",
    "SELECT count(*) AS n_months, round(avg(e.m - p.m),5) AS mean_diff, round(stddev_samp(e.m - p.m)/sqrt(count(*)),5) AS se FROM (SELECT month, avg(adj_ret) AS m FROM vol_v GROUP BY 1) e JOIN (SELECT month, avg(y) AS m FROM elig_v WHERE y IS NOT NULL GROUP BY 1) p ON p.month=e.month",
    **PV,
)
def h16(v):
    pop, vol, _ = both(v)
    d = S.equal_month_diff(vol.withColumnRenamed("adj_ret", "y"), pop, "month", "y")
    return d.select("n_months", r("mean_diff", 5), r("se", 5))


@query(
    "h17_pooled_versus_daily",
    "SELECT sum(n)::BIGINT AS n, round(sum(s)/sum(n),9) AS pooled_mean, round(avg(m),9) AS mean_of_day_means, round(sum(CASE WHEN m < 0 THEN n ELSE 0 END)/sum(n),9) AS share_on_negative_days FROM (SELECT day, count(*) AS n, sum(net_ret) AS s, avg(net_ret) AS m FROM trades_v GROUP BY 1)",
)
def h17(v):
    p = S.pooled_versus_daily(v.trades(), "day", "net_ret")
    return p.select("n", r("pooled_mean"), r("mean_of_day_means"), r("share_on_negative_days"))


@query(
    "h18_sampled_baseline",
    "SELECT ticker, d FROM (SELECT e.*, row_number() OVER (PARTITION BY e.ticker ORDER BY ('0x'||substr(md5(concat_ws('|','baseline',e.ticker,CAST(e.d AS VARCHAR))),1,8))::UBIGINT, e.d) AS r, k.n FROM elig_v e JOIN (SELECT ticker, 3*count(*) AS n FROM vol_v GROUP BY 1) k ON k.ticker=e.ticker) WHERE r <= n",
    **PV,
)
def h18(v):
    pop, vol, _ = both(v)
    return S.sampled_baseline(pop, vol.filter("adj_ret IS NOT NULL"), "d").select("ticker", "d")
