"""Registered queries: relevance, news type, sentiment and entity resolution."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators import text as X
from tidemark.plans.cleaning_queries import NAMES_SQL, SYM_SQL, company_names, symbols
from tidemark.plans.registry import query
from tidemark.session import checkpoint_dir
from tidemark.streaming.live import exists

PROFILES = {"click": "With Holdings", "view": "There Group", "error": "And Of Co", "signup": "Wer Ist AG", "purchase": "La Que SA"}
CASE_NAME = "CASE ticker " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in PROFILES.items()) + " END"


def profiled(v):
    c = F.col("ticker")
    name = F.coalesce(*[F.when(c == k, n) for k, n in PROFILES.items()])
    return v.universe().withColumn("name", name)


@query(
    "c1_name_variants",
    r"SELECT s_suppkey, list_sort(list_distinct(list_filter([array_to_string(t,' '), CASE WHEN len(t)>=2 THEN array_to_string(t[1:2],' ') END, CASE WHEN length(t[1])>=6 THEN t[1] END], lambda x: x IS NOT NULL AND length(x)>=3))) AS variants "
    r"FROM (SELECT s_suppkey, list_filter(string_split_regex(trim(regexp_replace(lower(name),'[^a-z0-9& ]+',' ','g')),' +'), lambda w: w NOT IN ('inc','incorporated','corp','corporation','co','company','plc','ltd','limited','sa','ag','nv','holdings','group','&','')) AS t FROM names_v)",
    names_v=NAMES_SQL,
)
def c1(v):
    return company_names(v).select("s_suppkey", F.sort_array(X.name_variants("name")).alias("variants"))


EL, ER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
PATTERNS = {"click": "click|with", "view": "view|there", "error": "error|and of", "signup": "signup|wer ist", "purchase": "purchase|la que"}
PAT_CASE = "CASE ticker " + " ".join(f"WHEN '{k}' THEN '(?i){EL}({p}){ER}'" for k, p in PATTERNS.items()) + " END"
TIER = (
    f"SELECT *, CASE WHEN regexp_matches(headline, {PAT_CASE}) THEN 1 WHEN regexp_matches(concat_ws(' ', headline, summary), {PAT_CASE}) THEN 2 ELSE 3 END AS tier FROM news_v"
)


@query("c2_relevance_tier", "SELECT news_id, tier AS relevance_tier FROM tier_v", tier_v=TIER)
def c2(v):
    return X.relevance_tier(v.news(), X.matchers(profiled(v))).select("news_id", "relevance_tier")


@query("c3_strict_sources", "SELECT news_id, CASE WHEN source IN ('src1','src2','src3') AND tier > 1 THEN 3 ELSE tier END AS relevance_tier FROM tier_v", tier_v=TIER)
def c3(v):
    return X.relevance_tier(v.news(), X.matchers(profiled(v)), strict_sources=["src1", "src2", "src3"]).select("news_id", "relevance_tier")


@query("c4_keep_relevant", "SELECT news_id, ticker FROM tier_v WHERE tier < 3", tier_v=TIER)
def c4(v):
    return X.keep_relevant(X.relevance_tier(v.news(), X.matchers(profiled(v)))).select("news_id", "ticker")


@query("c4_tier_counts", "SELECT tier AS relevance_tier, count(*) AS n FROM tier_v GROUP BY 1", tier_v=TIER)
def c4n(v):
    return X.tier_counts(X.relevance_tier(v.news(), X.matchers(profiled(v))))


def _type_sql(types):
    def re2(p):
        body = p[len(r"\b("):-1].replace(r"\b", ER).replace(r"\w", r"[\p{L}\p{N}_]")
        return f"{EL}({body})"

    whens = " ".join(f"WHEN regexp_matches(t, '{re2(p)}') THEN '{n}'" for n, p in types)
    return f"SELECT news_id, CASE {whens} ELSE 'other' END AS news_type FROM (SELECT news_id, lower(concat_ws(' ', headline, summary)) AS t FROM news_v)"


# Same classifier with patterns that occur in the invented prose of the check data.
PROSE_TYPES = [("the_type", r"\b(the on|there\w* of|thed\b)"), ("and_type", r"\b(and|ing with)"), ("der_type", r"\b(der |ist|que\b)")]


@query("c5_news_type", _type_sql(X.NEWS_TYPES))
def c5(v):
    return v.news().select("news_id", X.news_type("headline", "summary").alias("news_type"))


@query("c5_news_type_prose", _type_sql(PROSE_TYPES))
def c5p(v):
    return v.news().select("news_id", X.news_type("headline", "summary", PROSE_TYPES).alias("news_type"))


def _hits(words):
    return "len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\\p{L}]+')), [" + ",".join(f"'{w}'" for w in words) + "]))"


# Word lists that occur in the invented prose of the check data.
PROSE_WORDS = [*X.POSITIVE, "the", "and", "of"], [*X.NEGATIVE, "on", "in", "la"]
SENT = f"SELECT doc_id, pos, neg, pos + neg + 1.0 AS tot FROM (SELECT doc_id, {_hits(PROSE_WORDS[0])}::DOUBLE AS pos, {_hits(PROSE_WORDS[1])}::DOUBLE AS neg FROM documents)"


@query("c6_score_with_cache", "SELECT doc_id, round((pos-neg)/tot, 9) AS sent_score, 0::BIGINT AS n_scored_again FROM sent_v", sent_v=SENT)
def c6(v):
    """Two runs over a written cache: the first scores some sources, the second the rest; a third scores nothing."""
    docs = v.table("documents").select("doc_id", "text", "source")
    cache = f"{checkpoint_dir(v.spark)}/scores-{uuid.uuid4().hex}"

    def run(items):
        known = v.spark.read.schema(X.SCORES).parquet(cache) if exists(v.spark, cache) else None
        return X.score_with_cache(items, "text", known, lambda t: X.word_list_scorer(t, *PROSE_WORDS))

    for part in (docs.filter("source IN ('src1','src2','src3','src4')"), docs):
        run(part.select("doc_id", "text"))[1].write.mode("append").parquet(cache)
    scored, fresh = run(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.round("sent_score", 9).alias("sent_score"), fresh.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_scored_again"))


@query(
    "c7_normalized_sentiment",
    "SELECT id, round(p0/s,9) AS p_pos, round(p1/s,9) AS p_neg, round(p2/s,9) AS p_neu, round((p0-p1)/s,9) AS sent_score FROM (SELECT *, CASE WHEN p0+p1+p2 = 0 THEN 1 ELSE p0+p1+p2 END AS s FROM probs_v)",
)
def c7(v):
    cols = X.normalized_sentiment(F.col("p0"), F.col("p1"), F.col("p2"))
    return v.probs().select("id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


ISSUERS_SQL = (
    "SELECT f.accession, f.issuer, n.name AS issuer_name, CASE WHEN f.issuer % 7 = 0 THEN 'NONE' WHEN f.issuer % 11 = 0 THEN NULL ELSE s.symbol END AS symbol FROM filings_v f "
    "JOIN names_v n ON n.s_suppkey = f.issuer JOIN sym_v s ON s.o_orderkey = f.accession"
)
LOOK_SQL = (
    r"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_norm ORDER BY accession) AS r2 FROM (SELECT accession, issuer, CASE WHEN accession % 5 = 3 THEN NULL ELSE regexp_extract(symbol, 'T[0-9]+') END AS ticker, "
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(issuer_name), '[.,''&]', ' ', 'g'), '\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|LLC|LP|PLC|THE)\b|/(DE|MD|NEW|VA)/', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name_norm "
    "FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY accession) AS r1 FROM issuers_v) WHERE r1=1 AND symbol IS NOT NULL AND symbol <> 'NONE') WHERE ticker IS NOT NULL) WHERE r2=1"
)
EV = {"names_v": NAMES_SQL, "sym_v": SYM_SQL, "issuers_v": ISSUERS_SQL, "look_v": LOOK_SQL}


def issuer_filings(v):
    i = F.col("issuer")
    f = v.filings().join(company_names(v).withColumnRenamed("s_suppkey", "issuer"), "issuer").join(symbols(v).withColumnRenamed("o_orderkey", "accession"), "accession")
    sym = F.when(i % 7 == 0, "NONE").when(i % 11 != 0, F.col("symbol"))
    return f.select("accession", "issuer", F.col("name").alias("issuer_name"), sym.alias("symbol"))


@query("c8_issuer_lookup", "SELECT name_norm, issuer, ticker FROM look_v", **EV)
def c8(v):
    return X.issuer_lookup(issuer_filings(v), "accession")


HOLD_SQL = "SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS hid, n.name, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'C' || l_partkey END AS cusip, l_extendedprice/l_quantity AS price FROM lineitem JOIN names_v n ON n.s_suppkey = l_suppkey"
MAP_SQL = "SELECT 'C' || p.l_partkey AS cusip, arg_min('M' || (l_partkey % 50), (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) * 100000000 + l_orderkey * 10 + l_linenumber) AS ticker FROM (SELECT * FROM lineitem WHERE l_partkey % 2 = 0) p GROUP BY 1"
RES_SQL = (
    r"SELECT h.hid, h.price, coalesce(l.ticker, m.ticker) AS resolved_ticker, CASE WHEN l.ticker IS NOT NULL THEN 'name' WHEN m.ticker IS NOT NULL THEN 'identifier' END AS method FROM (SELECT *, "
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(name), '[.,''&]', ' ', 'g'), '\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|LLC|LP|PLC|THE)\b|/(DE|MD|NEW|VA)/', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name_norm FROM hold_v) h "
    "LEFT JOIN look_v l ON l.name_norm=h.name_norm LEFT JOIN map_v m ON m.cusip=h.cusip"
)
RV = {**EV, "hold_v": HOLD_SQL, "map_v": MAP_SQL, "res_v": RES_SQL}


def holdings(v):
    li = v.table("lineitem")
    named = li.join(company_names(v), li.l_suppkey == F.col("s_suppkey"))
    return named.select(
        (((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("hid"), "name",
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("C"), "l_partkey")).alias("cusip"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def identifier_map(v):
    li = v.table("lineitem").filter("l_partkey % 2 = 0").select(
        F.concat(F.lit("C"), "l_partkey").alias("cusip"), F.concat(F.lit("M"), F.col("l_partkey") % 50).alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "Equity").otherwise("Other").alias("sector"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return X.one_mapping_per_identifier(li, "cusip", "sector", "pos")


@query("c9_resolve_tickers", "SELECT hid, resolved_ticker, method FROM res_v", **RV)
def c9(v):
    lookup = X.issuer_lookup(issuer_filings(v), "accession")
    return X.resolve_tickers(holdings(v), lookup, identifier_map(v)).select("hid", "resolved_ticker", "method")


@query("c10_equity_mapping_first", "SELECT l_partkey AS part, arg_min(l_orderkey, (CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END) * 100000000 + l_orderkey * 10 + l_linenumber) AS chosen FROM lineitem GROUP BY 1")
def c10(v):
    li = v.table("lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("chosen"), F.when(F.col("l_returnflag") == "R", "Equity").otherwise("Other").alias("sector"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return X.one_mapping_per_identifier(li, "part", "sector", "pos").select("part", "chosen")


@query(
    "c11_fill_issuer",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END END AS issuer_final FROM orders",
)
def c11(v):
    o = v.table("orders").select("o_orderkey", F.concat(F.lit("t"), "o_custkey").alias("ticker"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("issuer"))
    second = v.table("orders").filter("o_custkey % 4 <> 0").select(F.concat(F.lit("T"), "o_custkey").alias("ticker"), F.col("o_custkey").alias("issuer")).distinct()
    return X.fill_issuer(o, second).select("o_orderkey", "issuer_final")


@query("c12_latest_filing_as_of", "SELECT issuer, filing_date, accession FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY filing_date DESC, accession DESC) AS r FROM filings_v WHERE filing_date <= DATE '1996-06-30') WHERE r=1")
def c12(v):
    return X.latest_on_or_before(v.filings(), "issuer", "filing_date", F.lit("1996-06-30").cast("date"))


@query(
    "c13_liquidity_funnel",
    "SELECT count(*) AS n_resolved, count(*) FILTER (price >= 1500) AS n_price, count(*) FILTER (price >= 1500 AND adv >= 300) AS n_adv, count(DISTINCT CASE WHEN price >= 1500 AND adv >= 300 THEN resolved_ticker END) AS n_share_class "
    "FROM res_v LEFT JOIN (SELECT resolved_ticker AS tk, count(*)::DOUBLE AS adv FROM res_v WHERE resolved_ticker IS NOT NULL GROUP BY 1) a ON a.tk = resolved_ticker WHERE resolved_ticker IS NOT NULL",
    **RV,
)
def c13(v):
    res = X.resolve_tickers(holdings(v), X.issuer_lookup(issuer_filings(v), "accession"), identifier_map(v))
    adv = res.filter("resolved_ticker IS NOT NULL").groupBy(F.col("resolved_ticker").alias("ticker")).agg(F.count(F.lit(1)).cast("double").alias("adv"))
    return X.liquidity_funnel(X.liquidity_flags(res, adv, "hid", 1500, 300))


