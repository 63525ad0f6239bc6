"""Registered queries: payload parsing and log shapes."""

import uuid

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.registry import query
from tidemark.session import checkpoint_dir
from tidemark.sources import landing as G
from tidemark.sources import tables as T

US = F.unix_micros


def scratch(v):
    """A new folder beside the session's checkpoints."""
    return f"{checkpoint_dir(v.spark)}/tables-{uuid.uuid4().hex}"


def land(v, lines, key, order, name, page=None):
    """Landed files as a vendor leaves them: one text file per key, named by `name(key)`; returns their folder.

    `lines` has key, `order` and value. The files are written by Spark in order and renamed in their store. With the
    column `page` a key has one file per page, in the page's folder.
    """
    folder, keys = scratch(v), [key] if page is None else [page, key]
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, *order)
    ordered.select(*keys, "value").write.partitionBy(*keys).text(f"{folder}/_parts")
    hadoop = v.spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(v.spark._jsc.hadoopConfiguration())

    def folders(path):
        return [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]

    top = hadoop.Path(f"{folder}/_parts")
    for above, under in [(folder, top)] if page is None else [(f"{folder}/{p.getName().split('=', 1)[1]}", p) for p in folders(top)]:
        for d in folders(under):
            for f in fs.listStatus(d):
                if f.getPath().getName().startswith("part-"):
                    target = hadoop.Path(f"{above}/{name(d.getName().split('=', 1)[1])}")
                    fs.mkdirs(target.getParent())
                    fs.rename(f.getPath(), target)
    return folder


@query("a1_news_items", "SELECT news_id AS id, ticker, md5(headline) AS headline_md5, epoch_us(published_utc)//1000000 AS published_epoch FROM news_v")
def a1(v):
    """JSON arrays per ticker, written line by line (with an empty last item, which drops), then read.

    A ticker's items come in pages, as feeds give them, so that no file and no task holds all of a busy ticker.
    """
    item = F.to_json(F.struct(F.col("news_id").alias("id"), "headline", "summary", "source", F.unix_seconds("published_utc").alias("datetime")))
    # Fixed value: item numbers of a page.
    page = F.floor(F.col("news_id") / F.lit(10_000)).alias("page")
    n = v.news().select(page, "ticker", F.lit(1).alias("o"), F.col("news_id").alias("i"), F.concat(item, F.lit(",")).alias("value"))
    ends = v.news().select(page, "ticker").distinct().select("page", "ticker", F.inline(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(0).cast("long").alias("i"), F.lit(t).alias("value")) for o, t in ((0, "["), (2, "{}]"))])))
    folder = land(v, n.unionByName(ends), "ticker", ["o", "i"], lambda t: f"{t}.json", "page")
    return G.news_shape(G.read_news(v.spark, f"{folder}/[!_]*/*.json")).select("id", "ticker", F.md5("headline").alias("headline_md5"), "published_epoch")


@query("a2_bar_rename", "SELECT ticker, epoch_us(ts) AS ts_us, open, high, low, close, volume FROM bars_v")
def a2(v):
    b = v.bars()
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "open", "high", "low", "close", "volume", F.lit(""), F.lit(""))
    lines = b.select("ticker", F.lit(1).alias("o"), "ts", line.alias("value"))
    head = b.select("ticker").distinct().select("ticker", F.lit(0).alias("o"), F.lit(None).cast("timestamp").alias("ts"), F.lit("t,o,h,l,c,v,n,vw").alias("value"))
    folder = land(v, lines.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(head), "ticker", ["o", "ts"], lambda t: f"{t}_1min.csv")
    return G.read_bars(v.spark, folder).select("ticker", US("ts").alias("ts_us"), "open", "high", "low", "close", "volume")


@query("a3_benchmark_closes", "SELECT CAST(ts AS DATE) AS d, arg_max(close, ts) AS c FROM bars_v WHERE ticker='view' GROUP BY 1")
def a3(v):
    daily = v.bars().groupBy("ticker", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return G.benchmark_closes(daily, "view")


@query(
    "a4_calendar_sessions",
    "SELECT d, epoch_us((d + INTERVAL '6' HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AS start_us, epoch_us((d + INTERVAL '22' HOUR)::TIMESTAMP AT TIME ZONE 'America/New_York') AS end_us FROM sessions_v",
)
def a4(v):
    s = G.sessions_from_calendar(v.calendar().select("date", "open", "close"))
    return s.select("d", US("sess_start").alias("start_us"), US("sess_end").alias("end_us"))


@query("a5_filing_columns", "SELECT accession::VARCHAR AS accession, strftime(filing_date, '%Y-%m-%d') AS filing_date FROM filings_v")
def a5(v):
    """A TSV per quarter with a column that is pruned away."""
    f = v.filings().withColumn("q", F.concat(F.year("filing_date").cast("string"), F.lit("q"), F.quarter("filing_date").cast("string")))
    lines = f.select("q", F.lit(1).alias("o"), F.concat_ws("\t", F.lit("x"), F.col("accession").cast("string"), F.col("filing_date").cast("string")).alias("value"))
    head = f.select("q").distinct().select("q", F.lit(0).alias("o"), F.lit("EXTRA\taccession\tfiling_date").alias("value"))
    folder = land(v, lines.unionByName(head), "q", ["o"], lambda q: f"{q}/SUBMISSION.tsv")
    return G.read_filing_table(v.spark, folder, "SUBMISSION", ["accession", "filing_date"])


@query(
    "a6_holdings",
    "SELECT l_orderkey AS k, l_linenumber AS n, round(CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice/l_quantity END, 8) AS price FROM lineitem",
)
def a6(v):
    """Holdings as XML files, the key in the name and the line in the identifier."""
    li = v.table("lineitem")
    bal = F.when(F.col("l_linenumber") % 4 == 0, F.lit("N/A")).otherwise(F.col("l_quantity").cast("string"))
    folder = scratch(v)
    rows = li.select(F.col("l_orderkey").cast("string").alias("name"), F.col("l_linenumber").cast("string").alias("cusip"), bal.alias("balance"), F.col("l_extendedprice").cast("string").alias("valUSD"))
    rows.write.option("rootTag", "invstOrSecs").option("rowTag", "invstOrSec").xml(folder)
    h = G.read_holdings(v.spark, folder)
    return h.select(F.col("name").cast("long").alias("k"), F.col("cusip").cast("long").alias("n"), F.round("price", 8).alias("price"))


@query(
    "a7_corporate_actions",
    "SELECT event_type AS ticker, strftime(ts,'%Y-%m-%d') AS ex_date, CASE event_id % 3 WHEN 0 THEN 'reverse_split' WHEN 1 THEN 'forward_split' ELSE 'spin_off' END AS type FROM events WHERE event_type <> 'view'",
)
def a7(v):
    i = F.col("event_id")
    spin = i % 3 == 2
    row = F.struct(
        F.when(~spin, F.col("event_type")).alias("symbol"), F.when(spin, F.col("event_type")).alias("source_symbol"), F.lit("view").alias("new_symbol"), F.date_format("ts", "yyyy-MM-dd").alias("ex_date")
    )
    kind = F.when(i % 3 == 0, "reverse_splits").when(i % 3 == 1, "forward_splits").otherwise("spin_offs")
    body = F.to_json(F.struct(F.create_map(kind, F.array(row)).alias("corporate_actions")))
    e = v.table("events").filter("event_type <> 'view'").select(body.alias("payload"))
    return G.corporate_actions(e, "payload", v.universe())


def articles(v):
    d = v.table("documents").join(v.table("events").select(F.col("event_id").alias("doc_id"), "event_type", "ts"), "doc_id")
    syms = F.filter(F.array(F.col("event_type"), F.when(F.col("doc_id") % 2 == 0, "purchase2"), F.when(F.col("doc_id") % 3 == 0, "view2"), F.when(F.col("doc_id") % 5 == 0, "click")), lambda s: s.isNotNull())
    created = F.when(F.col("doc_id") % 17 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("headline"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).otherwise("").alias("source"), created.alias("created_at"), syms.alias("symbols"))


ART = (
    "SELECT id, t AS ticker, n_symbols, CASE WHEN id % 4 <> 0 THEN source ELSE '' END AS source, ts FROM (SELECT id, source, ts, len(s) AS n_symbols, unnest(s) AS t FROM (SELECT doc_id AS id, d.source, e.ts, list_filter([e.event_type, CASE WHEN doc_id%2=0 THEN 'purchase2' END, CASE WHEN doc_id%3=0 THEN 'view2' END, CASE WHEN doc_id%5=0 THEN 'click' END], lambda x: x IS NOT NULL) AS s "
    "FROM documents d JOIN events e ON e.event_id=d.doc_id)) WHERE t IN (SELECT ticker FROM universe_v)"
)


@query("a8_explode_articles", "SELECT id, ticker, n_symbols FROM art_v", art_v=ART)
def a8(v):
    return G.explode_articles(articles(v), v.universe()).select("id", "ticker", "n_symbols")


@query("a9_feed_shape", "SELECT id, ticker, CASE WHEN source='' THEN 'feed2' ELSE source END AS source, epoch_us(ts)//1000000 AS datetime FROM art_v WHERE id % 17 <> 0", art_v=ART)
def a9(v):
    return G.feed_shape(G.explode_articles(articles(v), v.universe())).select("id", "ticker", "source", "datetime")


@query("a11_added_columns", "SELECT signal_id, CASE WHEN status='fired' THEN news_source END AS news_source, CASE WHEN status='fired' THEN n_symbols END AS n_symbols FROM signals_v")
def a11(v):
    s = v.signals().select("signal_id", "news_source", "n_symbols", "status")
    old = s.filter("status <> 'fired'").select("signal_id")
    return T.with_added_columns(old, s.filter("status = 'fired'").drop("status")).select("signal_id", "news_source", "n_symbols")


@query("a15_daily_bar_map", "SELECT event_type AS ticker, CAST(ts AS DATE) AS d, max(value) AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1,2")
def a15(v):
    day = v.table("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.max("value").alias("c"), F.count(F.lit(1)).cast("double").alias("v"))
    bar = F.struct(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), "c", "v")
    dead = F.struct(F.lit("1999-01-01T00:00:00Z").alias("t"), F.lit(1.0).alias("c"), F.lit(0.0).alias("v"))
    payload = F.to_json(F.create_map(F.col("event_type"), F.array(bar, bar, dead)))
    return G.daily_bars_from_map(day.select(payload.alias("p")), "p").select("ticker", "d", "c", "v")


@query("a10_append_log", "SELECT CAST(ts_utc AS DATE) AS day, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM signals_v GROUP BY 1")
def a10(v):
    root, s = scratch(v), v.signals()
    T.append_log(s.filter("status = 'fired'"), root, "signals")
    T.append_log(s.filter("status <> 'fired'"), root, "signals")
    return T.read_log(v.spark, root, "signals").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("n_tickers"))


@query("a12_dataset_by_month", "SELECT strftime(filing_date,'%Y-%m') AS month, count(*) AS n FROM filings_v GROUP BY 1")
def a12(v):
    path = scratch(v)
    T.write_by_month(v.filings(), path, "filing_date")
    back = v.spark.read.schema("accession long, filing_date date, month string").parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("a13_small_results", "SELECT class_name, count(*) AS n FROM signals_v GROUP BY 1")
def a13(v):
    path = scratch(v)
    T.write_small_csv(v.signals().groupBy("class_name").agg(F.count(F.lit(1)).alias("n")), path)
    return v.spark.read.schema("class_name string, n long").option("header", True).csv(path)


@query("a14_universe_table", "SELECT CASE WHEN event_type IN ('click','view') THEN 'A' END AS sector, count(*) AS n FROM events GROUP BY 1")
def a14(v):
    u = T.universe_table(v.spark, [("click", "A"), ("view", "A")])
    e = v.table("events").select(F.col("event_type").alias("ticker")).join(u, "ticker", "left")
    return e.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
