"""Registered queries: sorts, set operations and scalar functions as the operators use them."""

from pyspark.sql import functions as F

from tidemark.operators.labels import equal_count_bin
from tidemark.functions.scan import rank_rows
from tidemark.plans.registry import query

US = F.unix_micros


@query("l1_stable_sort", "SELECT ticker, class_name, signal_id FROM signals_v ORDER BY ticker, class_name, signal_id")
def l1(v):
    return v.signals().select("ticker", "class_name", "signal_id").orderBy("ticker", "class_name", "signal_id")


@query("l2_top_k", "SELECT source, n FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 5")
def l2(v):
    return v.table("documents").groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy(F.col("n").desc(), "source").limit(5)


@query("l3_concat_frames", "SELECT 'event' AS kind, event_type AS k, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'doc', source, count(*) FROM documents GROUP BY 2")
def l3(v):
    e = v.table("events").select(F.lit("event").alias("kind"), F.col("event_type").alias("k"))
    d = v.table("documents").select(F.col("source").alias("k"), F.lit("doc").alias("kind"))
    return e.unionByName(d).groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l4_key_sets",
    "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unseen', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)",
)
def l4(v):
    d, s = v.table("documents").select("doc_id"), v.table("labels").select("doc_id")
    both = d.intersect(s).agg(F.lit("both").alias("part"), F.count(F.lit(1)).alias("n"))
    return both.unionByName(d.exceptAll(s).agg(F.lit("unseen").alias("part"), F.count(F.lit(1)).alias("n")))


@query(
    "l5_string_functions",
    "SELECT doc_id, upper(substr(source,1,3)) AS u, regexp_extract(source,'[0-9]+') AS digits, len(string_split(text,' '))::INT AS words, md5(regexp_replace(text,'[aeiou]','*','g')) AS masked, regexp_matches(text,'the') AS has_the FROM documents",
)
def l5(v):
    return v.table("documents").select(
        "doc_id", F.upper(F.substring("source", 1, 3)).alias("u"), F.regexp_extract("source", "[0-9]+", 0).alias("digits"), F.size(F.split("text", " ", -1)).alias("words"),
        F.md5(F.regexp_replace("text", "[aeiou]", "*")).alias("masked"), F.col("text").rlike("the").alias("has_the"),
    )


@query(
    "l6_date_functions",
    "SELECT event_id, epoch_us(time_bucket(INTERVAL '15' MINUTE, ts)) AS floor_us, CAST(date_trunc('week', ts) AS DATE) AS week, strftime(ts,'%Y-%m') AS month, epoch_us(ts)//1000000 AS epoch, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS et_day FROM events",
)
def l6(v):
    return v.table("events").select(
        "event_id", US(F.window("ts", "15 minutes").start).alias("floor_us"), F.to_date(F.date_trunc("week", "ts")).alias("week"), F.date_format("ts", "yyyy-MM").alias("month"), F.unix_seconds("ts").alias("epoch"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"), F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("et_day"),
    )


@query(
    "l7_math_functions",
    "SELECT event_id, round(ln(value),8) AS ln, round(sqrt(value),8) AS sq, abs(value-40) AS a, sign(value-40)::INT AS sg, least(greatest(value,10),100) AS clipped FROM events",
)
def l7(v):
    x = F.col("value")
    return v.table("events").select(
        "event_id", F.round(F.ln(x), 8).alias("ln"), F.round(F.sqrt(x), 8).alias("sq"), F.abs(x - 40).alias("a"), F.signum(x - 40).cast("int").alias("sg"), F.least(F.greatest(x, F.lit(10.0)), F.lit(100.0)).alias("clipped"),
    )


@query("l8_array_functions", "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses, count(*) FILTER (o_totalprice > 1000) AS n_big FROM orders GROUP BY 1")
def l8(v):
    return v.table("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"), F.count_if(F.col("o_totalprice") > 1000).alias("n_big"))


@query("l9_json_parse", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def l9(v):
    return v.table("events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query(
    "l10_null_handling",
    "SELECT d.doc_id, coalesce(l.quality,-1) AS quality, l.toxic IS NOT DISTINCT FROM CASE WHEN d.doc_id % 2 = 0 THEN 0 END AS same FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id",
)
def l10(v):
    j = v.table("documents").select("doc_id").join(v.table("labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").eqNullSafe(F.when(F.col("doc_id") % 2 == 0, 0)).alias("same"))


@query(
    "l11_cut_and_quantile_bins",
    "SELECT CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS band, q, count(*) AS n FROM (SELECT *, ntile(7) OVER (ORDER BY value, event_id) AS q FROM events) GROUP BY 1,2",
)
def l11(v):
    e = v.table("events").select("event_id", "value")
    n = e.agg(F.count(F.lit(1))).scalar()
    x = F.col("value")
    b = rank_rows(e, [], "value", "event_id").withColumn("q", equal_count_bin(F.col("pos"), n, 7))
    return b.groupBy(F.when(x <= 10, "low").when(x <= 50, "mid").otherwise("high").alias("band"), "q").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l12_unpivot_pivot",
    "SELECT metric, sum(x) FILTER (ticker='click') AS click, sum(x) FILTER (ticker='view') AS view FROM (SELECT ticker, 'n' AS metric, count(*)::DOUBLE AS x FROM signals_v GROUP BY 1 UNION ALL SELECT ticker, 'fired', count(*) FILTER (status='fired')::DOUBLE FROM signals_v GROUP BY 1) GROUP BY 1",
)
def l12(v):
    g = v.signals().groupBy("ticker").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("status") == "fired").cast("double").alias("fired"))
    return g.unpivot(["ticker"], ["n", "fired"], "metric", "x").groupBy("metric").pivot("ticker", ["click", "view"]).sum("x")


