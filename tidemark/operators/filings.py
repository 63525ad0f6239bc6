"""Insider-filing events: qualification, roles, sizes, clusters and scored returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.operators import align as A
from tidemark.operators import features as E
from tidemark.session import settle


def qualifying_lines(filings: DataFrame, lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Purchase lines (code P) of original forms filed for target issuers."""
    ok = filings.filter(F.col("document_type") == "4").join(targets.select("issuer"), "issuer", "left_semi")
    return lines.filter(F.col("trans_code") == "P").join(ok, "accession")


def purchase_filings(lines: DataFrame) -> DataFrame:
    """One event per filing: dollars summed over its purchase lines."""
    return lines.groupBy("accession").agg(
        F.min("filing_date").alias("filing_date"), F.min("issuer").alias("issuer"), F.min("aff10b5one").alias("aff10b5one"),
        F.sum(F.col("shares") * F.col("price")).alias("dollar_amt"), F.count("trans_code").alias("n_p_lines"),
    )


def filing_roles(owners: DataFrame, ends: bool = False) -> DataFrame:
    """CEO_CFO when any title says so, else Director when any relationship does, else Other.

    With `ends` also the filing's smallest and largest owner (`_a`, `_z`), which `cluster_flags` reads.
    """
    # Words of an executive title.
    top = F.upper("title").rlike("CEO|CHIEF EXECUTIVE|CFO|CHIEF FINANCIAL")
    rank = F.when(F.coalesce(top, F.lit(False)), 2).when(F.coalesce(F.col("relationship").contains("Director"), F.lit(False)), 1).otherwise(0)
    r = owners.groupBy("accession").agg(F.max(rank).alias("_r"), *([F.min("owner").alias("_a"), F.max("owner").alias("_z")] if ends else []))
    role = F.when(F.col("_r") == 2, "CEO_CFO").when(F.col("_r") == 1, "Director").otherwise("Other").alias("role")
    return r.select("accession", role, *(["_a", "_z"] if ends else []))


def size_bucket(dollars: str | Column) -> Column:
    d = F.col(dollars) if isinstance(dollars, str) else dollars
    return F.when(d < 50_000, "<$50k").when(d < 500_000, "$50k-$500k").otherwise(">$500k")


def plan_flag(text: str) -> Column:
    return F.coalesce(F.lower(F.col(text)).isin("1", "true"), F.lit(False))


def owner_sets(owners: DataFrame) -> DataFrame:
    return owners.groupBy("accession").agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def cluster_flags(events: DataFrame, owners: DataFrame | None = None, days: int = P.CLUSTER_DAYS) -> DataFrame:
    """At least two distinct owners of the issuer filed within +/- `days` (looks both ways).

    Two or more owners in the window means smallest and largest owner differ, so issuer-days carry
    just those two values and a range window reads them: no self-join, no sets, and at most one row
    per issuer and day however many filings an issuer has. Without `owners` the events bring role and ends of their
    owners along (`filing_roles`); those that name no owner have no role.
    """
    if owners is None:
        filed = events.filter(F.col("role").isNotNull())
    else:
        ends = owners.groupBy("accession").agg(F.min("owner").alias("_a"), F.max("owner").alias("_z"))
        filed = events.select("accession", "issuer", "filing_date").join(ends, "accession")
    per_day = filed.groupBy("issuer", "filing_date").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    w = Window.partitionBy("issuer").orderBy(F.unix_date("filing_date")).rangeBetween(-days, days)
    flags = per_day.select("issuer", "filing_date", (F.min("_a").over(w) < F.max("_z").over(w)).alias("is_cluster"))
    j = events.join(flags, ["issuer", "filing_date"], "left")
    return j.withColumn("is_cluster", F.coalesce("is_cluster", F.lit(False)))


def quarter_funnel(filings: DataFrame, lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Per quarter: candidate filings, purchase lines and filings with one."""
    q = F.concat(F.year("filing_date"), F.lit("q"), F.quarter("filing_date"))
    cand = filings.filter(F.col("document_type") == "4").join(targets.select("issuer"), "issuer", "left_semi").withColumn("quarter", q)
    per_filing = lines.filter(F.col("trans_code") == "P").groupBy("accession").agg(F.count(F.lit(1)).alias("_l"))
    j = cand.join(per_filing, "accession", "left")
    return j.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("_l"), F.lit(0)).alias("p_lines"), F.count("_l").alias("filings")
    )


def purchase_events(filings: DataFrame, lines: DataFrame, owners: DataFrame, targets: DataFrame, settle_owners: bool = True) -> DataFrame:
    """Classified purchase events, one per filing.

    The owners are read once: role, smallest and largest owner of a filing meet its lines where these lie by filing. That is
    settled, as the flags of the issuer-days are made of it and meet it again. Repeated owners count once.
    Without `settle_owners` the filings are settled before they meet their owners: where nobody reads role and flags, Spark
    then leaves the owners out.
    """
    ev = purchase_filings(qualifying_lines(filings, lines, targets))
    ev = ev.withColumn("is_10b5_1", plan_flag("aff10b5one")).withColumn("size_bucket", size_bucket("dollar_amt"))
    full = (ev if settle_owners else settle(ev)).join(filing_roles(owners, ends=True), "accession", "left")
    return cluster_flags(settle(full) if settle_owners else full).select(*ev.columns, "is_cluster", "role")


def distributions(events: DataFrame) -> DataFrame:
    """Counts by year, role, size and cluster in one pass of grouping sets."""
    e = events.select(F.year("filing_date").alias("year"), "role", "size_bucket", "is_cluster", "is_10b5_1")
    g = e.groupingSets(
        [["year"], ["role"], ["size_bucket"], ["is_cluster"]], "year", "role", "size_bucket", "is_cluster"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_10b5_1")).alias("n_voluntary"), F.grouping_id().alias("_g"))
    # Grouping bits from the left: year, role, size, cluster; a zero bit is the set's own column.
    dim = F.when(F.col("_g") == 7, "year").when(F.col("_g") == 11, "role").when(F.col("_g") == 13, "size").otherwise("cluster")
    val = F.when(F.col("_g") == 7, F.col("year").cast("string")).when(F.col("_g") == 11, F.col("role")).when(F.col("_g") == 13, F.col("size_bucket")).otherwise(F.col("is_cluster").cast("string"))
    return g.select(dim.alias("dimension"), val.alias("value"), "n", "n_voluntary")


def score_events(events: DataFrame, daily: DataFrame, bench: DataFrame, anchor: str = "filing_date", horizons: Sequence[int] = P.STUDY_HORIZONS, gap_days: int = P.HALT_GAP_DAYS) -> DataFrame:
    """Events with beta-adjusted returns per horizon (long form)."""
    # One pass over a ticker's bars: the bar that an event enters at knows its exits and the betas of the two bars before it,
    # the nearer of which may be the anchor date itself.
    rets = E.event_beta(E.returns_with_bench(daily, bench), keep=["c"])
    w = Window.partitionBy("ticker").orderBy("d")
    past = F.struct("d", "beta", "beta_n")
    rets = rets.select("ticker", "d", "c", F.array(F.lag(past, 1).over(w), F.lag(past, 2).over(w)).alias("before"))
    path = A.daily_path(rets, gap_days, horizons)
    points = events.select("ticker", anchor).distinct()
    exits = A.study_exits(A.study_entries(points, path, anchor), path, horizons)
    near, far = F.get("entry.before", F.lit(0)), F.get("entry.before", F.lit(1))
    b = F.when(near.getField("d") < F.col(anchor), near).when(far.getField("d") < F.col(anchor), far)
    withb = exits.withColumn("_b", b).select(*exits.columns, "_b.beta", "_b.beta_n")
    priced = A.bench_between(withb, bench, "entry_date", "exit_date").withColumn("adj_ret", F.col("ret") - F.col("beta") * F.col("bench_ret"))
    cols = ["h", "entry_date", "entry_price", "exit_date", "ret", "bench_ret", "beta", "beta_n", "adj_ret", "truncated"]
    return events.join(priced.select("ticker", anchor, *cols), ["ticker", anchor])
