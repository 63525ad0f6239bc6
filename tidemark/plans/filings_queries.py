"""Registered queries: insider-filing events."""

from pyspark.sql import functions as F

from tidemark.operators import filings as I
from tidemark.plans.alignment_queries import BENCHN, PATH
from tidemark.plans.features_queries import EB21, RET
from tidemark.plans.registry import query


def r(c, n=8, name=None):
    return F.round(c, n).alias(name or c)


TARGET = "SELECT s_suppkey AS issuer FROM supplier WHERE s_nationkey <> 3"
QL = "SELECT l.*, f.filing_date, f.issuer, f.aff10b5one FROM filing_lines_v l JOIN filings_v f ON f.accession=l.accession WHERE l.trans_code='P' AND f.document_type='4' AND f.issuer IN (SELECT issuer FROM target_v)"
PF = "SELECT accession, min(filing_date) AS filing_date, min(issuer) AS issuer, min(aff10b5one) AS aff10b5one, sum(shares*price) AS dollar_amt, count(*) AS n_p_lines FROM ql_v GROUP BY 1"
ROLE = "SELECT accession, CASE max(CASE WHEN title IN ('Chief Executive Officer','CFO') THEN 2 WHEN relationship='Director' THEN 1 ELSE 0 END) WHEN 2 THEN 'CEO_CFO' WHEN 1 THEN 'Director' ELSE 'Other' END AS role FROM owners_v GROUP BY 1"
SIZE = "CASE WHEN dollar_amt < 50000 THEN '<$50k' WHEN dollar_amt < 500000 THEN '$50k-$500k' ELSE '>$500k' END"
CL = "SELECT e.accession, (SELECT count(DISTINCT o.owner) FROM pf_v x JOIN owners_v o ON o.accession=x.accession WHERE x.issuer=e.issuer AND x.filing_date BETWEEN e.filing_date-30 AND e.filing_date+30) >= 2 AS is_cluster FROM pf_v e"
PE = f"SELECT p.*, aff10b5one='1' AS is_10b5_1, {SIZE} AS size_bucket, c.is_cluster, r.role, concat('S', issuer) AS ticker FROM pf_v p JOIN cl_v c ON c.accession=p.accession LEFT JOIN role_v r ON r.accession=p.accession"
V = {"target_v": TARGET, "ql_v": QL, "pf_v": PF, "role_v": ROLE, "cl_v": CL, "pe_v": PE}


def targets(v):
    return v.table("supplier").filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("issuer"))


def lines(v):
    return I.qualifying_lines(v.filings(), v.filing_lines(), targets(v))


def events(v, settle_owners=True):
    return I.purchase_events(v.filings(), v.filing_lines(), v.owner_lines(), targets(v), settle_owners).withColumn("ticker", F.concat(F.lit("S"), "issuer"))


@query("i1_qualifying_lines", "SELECT accession, issuer, filing_date, round(shares*price,4) AS dollars FROM ql_v", **V)
def i1(v):
    return lines(v).select("accession", "issuer", "filing_date", F.round(F.col("shares") * F.col("price"), 4).alias("dollars"))


@query("i2_purchase_filings", "SELECT accession, filing_date, issuer, round(dollar_amt,4) AS dollar_amt, n_p_lines FROM pf_v", **V)
def i2(v):
    return I.purchase_filings(lines(v)).select("accession", "filing_date", "issuer", r("dollar_amt", 4), "n_p_lines")


@query("i3_roles", ROLE)
def i3(v):
    return I.filing_roles(v.owners())


@query("i4_size_buckets", f"SELECT accession, {SIZE} AS size_bucket FROM pf_v", **V)
def i4(v):
    return I.purchase_filings(lines(v)).select("accession", I.size_bucket("dollar_amt").alias("size_bucket"))


@query("i5_plan_flag", "SELECT accession, aff10b5one='1' AS is_10b5_1 FROM filings_v")
def i5(v):
    return v.filings().select("accession", I.plan_flag("aff10b5one").alias("is_10b5_1"))


@query("i6_owner_sets", "SELECT accession, list_sort(list(DISTINCT owner)) AS owners FROM owners_v GROUP BY 1")
def i6(v):
    return I.owner_sets(v.owners())


@query("i7_cluster_flags", "SELECT accession, is_cluster FROM cl_v", **V)
def i7(v):
    ev = I.purchase_filings(lines(v))
    return I.cluster_flags(ev, v.owners()).select("accession", "is_cluster")


# A sparser owner set, so that single-owner windows occur.
@query(
    "i7_cluster_flags_sparse",
    "SELECT e.accession, (SELECT count(DISTINCT o.owner) FROM sp_v x JOIN so_v o ON o.accession=x.accession WHERE x.issuer=e.issuer AND x.filing_date BETWEEN e.filing_date-30 AND e.filing_date+30) >= 2 AS is_cluster FROM sp_v e",
    sp_v="SELECT o_orderkey AS accession, o_custkey AS issuer, CAST(o_orderdate AS DATE) AS filing_date FROM orders",
    so_v="SELECT o_orderkey AS accession, o_orderkey % 3 AS owner FROM orders",
)
def i7s(v):
    o = v.table("orders")
    ev = o.select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("issuer"), F.to_date("o_orderdate").alias("filing_date"))
    ow = o.select(F.col("o_orderkey").alias("accession"), (F.col("o_orderkey") % 3).alias("owner"))
    return I.cluster_flags(ev, ow).select("accession", "is_cluster")


@query(
    "i8_quarter_funnel",
    "SELECT year(f.filing_date) || 'q' || quarter(f.filing_date) AS quarter, count(*) AS candidates, coalesce(sum(l.n),0)::BIGINT AS p_lines, count(l.n) AS filings FROM filings_v f LEFT JOIN (SELECT accession, count(*) AS n FROM filing_lines_v WHERE trans_code='P' GROUP BY 1) l ON l.accession=f.accession "
    "WHERE f.document_type='4' AND f.issuer IN (SELECT issuer FROM target_v) GROUP BY 1",
    **V,
)
def i8(v):
    return I.quarter_funnel(v.filings(), v.filing_lines(), targets(v))


@query(
    "i9_distributions",
    "SELECT 'year' AS dimension, year(filing_date)::VARCHAR AS value, count(*) AS n, count(*) FILTER (NOT is_10b5_1) AS n_voluntary FROM pe_v GROUP BY 2 UNION ALL SELECT 'role', role, count(*), count(*) FILTER (NOT is_10b5_1) FROM pe_v GROUP BY 2 "
    "UNION ALL SELECT 'size', size_bucket, count(*), count(*) FILTER (NOT is_10b5_1) FROM pe_v GROUP BY 2 UNION ALL SELECT 'cluster', is_cluster::VARCHAR, count(*), count(*) FILTER (NOT is_10b5_1) FROM pe_v GROUP BY 2",
    **V,
)
def i9(v):
    return I.distributions(events(v))


SCORED = (
    "SELECT s.*, s.ret - s.beta*s.bench_ret AS adj_ret FROM (SELECT y.*, x.d AS exit_date, x.c/y.entry_price - 1 AS ret, CASE WHEN bz.i > ba.i THEN bz.c/ba.c - 1 END AS bench_ret, b.beta, b.beta_n FROM ("
    "SELECT e.accession, e.ticker, e.filing_date, e.is_10b5_1, e.role, e.size_bucket, e.is_cluster, h.h, p.d AS entry_date, p.c AS entry_price, coalesce(p.idx + h.h > p.halt_idx, false) OR p.idx + h.h > p.last_idx AS truncated, "
    "CASE WHEN coalesce(p.idx + h.h > p.halt_idx, false) THEN p.halt_idx ELSE least(p.idx + h.h, p.last_idx) END AS xi FROM pe_v e ASOF JOIN path_v p ON p.ticker=e.ticker AND p.d > e.filing_date CROSS JOIN (VALUES (5),(20),(60)) h(h)) y "
    "JOIN path_v x ON x.ticker=y.ticker AND x.idx=y.xi ASOF LEFT JOIN benchn_v ba ON ba.d >= y.entry_date ASOF LEFT JOIN benchn_v bz ON bz.d <= x.d ASOF LEFT JOIN ebeta_v b ON b.ticker=y.ticker AND b.d < y.filing_date) s"
)
SV = {**V, "path_v": PATH, "benchn_v": BENCHN, "ret_v": RET, "ebeta_v": EB21, "scored_ev_v": SCORED}


def scored(v, ev=None):
    """Scored events; `ev` are the events where a query has them already."""
    return I.score_events(events(v) if ev is None else ev, v.daily(), v.bench(), gap_days=25)


@query("i10_scored_events", "SELECT accession, h, exit_date, round(ret,6) AS ret, round(bench_ret,6) AS bench_ret, round(beta,5) AS beta, beta_n, round(adj_ret,4) AS adj_ret, truncated FROM scored_ev_v", **SV)
def i10(v):
    return scored(v).select("accession", "h", "exit_date", r("ret", 6), r("bench_ret", 6), r("beta", 5), "beta_n", r("adj_ret", 4), "truncated")


@query("i10_truncation_counts", "SELECT h, count(*) AS n, count(*) FILTER (truncated) AS n_truncated FROM scored_ev_v GROUP BY 1", **SV)
def i10t(v):
    return scored(v).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("n_truncated"))
