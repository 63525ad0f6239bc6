import json

from conftest import ts
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import text as X
from tidemark.operators.align import suppressed_until
from tidemark.sources import landing as G
from tidemark.sources import tables as T
from tidemark.streaming import live as K

NEWS = "id long, ticker string, headline string, summary string, source string, published_utc timestamp, arrival timestamp"


def test_news_and_bar_files(spark, tmp_path):
    (tmp_path / "news").mkdir()
    (tmp_path / "news" / "AA.json").write_text(json.dumps([{"datetime": 1704067200, "headline": "h", "summary": "s", "source": "x", "url": "", "id": 1}, {"datetime": None, "headline": "k"}]))
    (tmp_path / "news" / "BB.json").write_text(json.dumps([{"datetime": 1704067260, "headline": "b"}]))
    n = G.news_shape(G.read_news(spark, str(tmp_path / "news"))).orderBy("ticker").collect()
    assert [(r.ticker, r.headline, r.published_epoch) for r in n] == [("AA", "h", 1704067200), ("BB", "b", 1704067260)]
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "AA_1min.csv").write_text("t,o,h,l,c,v,n,vw\n2024-01-01T10:00:00Z,1,2,0.5,1.5,10,3,1.2\n")
    b = G.read_bars(spark, str(tmp_path / "bars")).first()
    assert (b.ticker, b.open, b.close, b.volume, b.vwap) == ("AA", 1.0, 1.5, 10, 1.2)


def test_filing_tables_and_holdings(spark, tmp_path):
    q = tmp_path / "f" / "2024q1"
    q.mkdir(parents=True)
    (q / "NONDERIV_TRANS.tsv").write_text("EXTRA\tACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\nz\ta1\t2024-01-02\tP\t10\t2.5\n")
    t = G.read_filing_table(spark, str(tmp_path / "f"), "NONDERIV_TRANS", schemas.FILING_LINE_COLUMNS)
    assert t.columns == schemas.FILING_LINE_COLUMNS and t.first().TRANS_CODE == "P"
    xml = tmp_path / "h.xml"
    xml.write_text("<d><genInfo><repPdDate>2024-03-31</repPdDate></genInfo><invstOrSec><name>A</name><cusip>1</cusip><balance>10</balance><valUSD>25</valUSD></invstOrSec><invstOrSec><name>B</name><balance>N/A</balance><valUSD>5</valUSD></invstOrSec></d>")
    h = {r.name: r.price for r in G.read_holdings(spark, str(xml)).collect()}
    assert h == {"A": 2.5, "B": None}
    assert str(G.report_date(spark, str(xml)).first().report_date) == "2024-03-31"


def test_corporate_actions_and_suppression(spark):
    body = json.dumps({"corporate_actions": {"reverse_splits": [{"symbol": "PAR", "ex_date": "2024-01-02"}], "spin_offs": [{"source_symbol": "PAR", "new_symbol": "KID", "ex_date": "2024-01-03"}]}})
    u = spark.createDataFrame([("PAR",), ("KID",)], "ticker string")
    acts = G.corporate_actions(spark.createDataFrame([(body,)], "b string"), "b", u)
    assert sorted(tuple(r) for r in acts.collect()) == [("PAR", "2024-01-02", "reverse_split"), ("PAR", "2024-01-03", "spin_off")]
    days = [ts(f"2024-01-{d:02d}T14:30:00") for d in range(1, 11)]
    s = spark.createDataFrame([(d,) for d in days], "sess_start timestamp")
    until = suppressed_until(acts, s, 3).collect()
    assert [(r.ticker, r.until_ts.timestamp()) for r in until] == [("PAR", days[5].timestamp())]


def test_winter_and_summer_sessions(spark):
    cal = spark.createDataFrame([("2024-01-03", "09:30", "1600"), ("2024-07-03", "930", "13:00")], "date string, open string, close string")
    got = [(r.sess_start.timestamp(), r.sess_end.timestamp()) for r in G.sessions_from_calendar(cal).orderBy("d").collect()]
    assert got == [(ts("2024-01-03T14:30:00").timestamp(), ts("2024-01-03T21:00:00").timestamp()), (ts("2024-07-03T13:30:00").timestamp(), ts("2024-07-03T17:00:00").timestamp())]


def test_logs_append_and_batches_overwrite_on_replay(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(ts("2024-01-01T00:00:00"), "A", "err")], "ts_utc timestamp, ticker string, error string")
    T.append_log(one, root, "poll_failures")
    T.append_log(one, root, "poll_failures")
    assert T.read_log(spark, root, "poll_failures").count() == 2
    T.write_batch(one, root, "b", 0)
    T.write_batch(one, root, "b", 0)
    assert spark.read.parquet(f"{root}/b").count() == 1
    T.write_by_month(one, f"{root}/m", "ts_utc")
    assert spark.read.parquet(f"{root}/m").first().month.__str__().startswith("2024")
    T.write_small_csv(one, f"{root}/csv")
    T.write_small_json(one, f"{root}/json")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == spark.read.json(f"{root}/json").count() == 1


def test_scorer_is_pluggable_and_scores_each_text_once(spark):
    import pandas as pd

    items = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "id int, text string")
    fake = X.pandas_scorer(lambda s: pd.DataFrame({"pos": (s == "good").astype(float), "neg": (s == "bad").astype(float), "neu": 0.0}))
    scored, fresh = X.score_with_cache(items, "text", None, fake)
    assert fresh.count() == 2
    assert {r.id: r.sent_score for r in scored.collect()} == {1: 1.0, 2: -1.0, 3: 1.0}
    _, again = X.score_with_cache(items, "text", fresh, fake)
    assert again.count() == 0


def test_case_sensitive_short_symbols(spark):
    u = spark.createDataFrame([("T", "Long Lines Co")], "ticker string, name string")
    n = spark.createDataFrame([(1, "T", "don't", ""), (2, "T", "Buy T now", ""), (3, "T", "x", "about LONG  LINES"), (4, "T", "x", "Long Lines!")], "id int, ticker string, headline string, summary string").withColumn("source", F.lit("s"))
    loose = {r.id: r.relevance_tier for r in X.relevance_tier(n, X.matchers(u)).collect()}
    strict = {r.id: r.relevance_tier for r in X.relevance_tier(n, X.matchers(u, 2)).collect()}
    assert loose == {1: 1, 2: 1, 3: 3, 4: 2} and strict == {1: 3, 2: 1, 3: 3, 4: 2}


def live(spark, root):
    from test_align_features import minute_bars, sessions

    bars = minute_bars(spark, [("2024-03-01 14:30", 390), ("2024-03-04 14:30", 390)])
    u = spark.createDataFrame([("X", "Xylo Works Inc")], "ticker string, name string")

    def score(df):
        return df.withColumns({"p0": F.lit(0.1), "p1": F.lit(0.1), "p2": F.lit(0.2), "p3": F.lit(0.6), "severity": F.lit(2.0)})

    return K.LiveRun(spark, root, bars, sessions(spark), X.matchers(u), score, {"Strong Buy": 0.5}, (-1.0, 1.0), min_bars=3), bars


def test_live_run_late_item_replay_and_outcomes(spark, tmp_path):
    run, bars = live(spark, str(tmp_path / "out"))
    rows = [
        (1, "X", "Xylo Works beats", "", "s", ts("2024-03-04T15:30:00"), ts("2024-03-04T15:40:00")),
        (2, "X", "Xylo Works beats", "", "s", ts("2024-03-04T15:30:00"), ts("2024-03-04T15:50:00")),  # same item again
        (3, "X", "Xylo Works late", "", "s", ts("2024-03-04T15:00:00"), ts("2024-03-04T16:01:00")),  # 61 minutes
        (4, "X", "unrelated", "", "s", ts("2024-03-04T15:31:00"), ts("2024-03-04T15:41:00")),
    ]
    src = tmp_path / "in"
    spark.createDataFrame(rows, NEWS).write.parquet(str(src))
    stream = K.union_feeds({"feed1": K.item_stream(spark, str(src), NEWS, "parquet", "*.parquet")})
    run.run(stream)
    out = spark.read.parquet(f"{run.root}/signals").collect()
    assert [(r.headline, r.status, r.class_name, r.severe) for r in out] == [("Xylo Works beats", "fired", "Strong Buy", 1)]
    lags = spark.read.parquet(f"{run.root}/retrieval_lag").collect()  # the first arrival of each item, without passing mentions
    assert sorted((r.headline, r.lag_minutes) for r in lags) == [("Xylo Works beats", 10.0), ("Xylo Works late", 61.0)]
    assert [r.headline for r in spark.read.parquet(f"{run.root}/stale_rejections").collect()] == ["Xylo Works late"]
    # The same batch again changes nothing; the same items in a later batch are known.
    batch = K.union_feeds({"feed1": spark.createDataFrame(rows, NEWS)})
    run.process(batch, 0)
    assert spark.read.parquet(f"{run.root}/signals").count() == 1
    run.process(batch, 1)
    assert spark.read.parquet(f"{run.root}/signals").count() == 1

    sig = spark.read.parquet(f"{run.root}/signals").select(F.lit(1).cast("long").alias("signal_id"), "ticker", F.col("published_utc").alias("ts_utc"), "entry_price", F.lit(None).cast("double").alias("stop_price"))
    none = spark.createDataFrame([], "signal_id long")
    early = K.resolve_outcomes(sig, none, bars, F.lit(ts("2024-03-04T17:34:00")))
    done = K.resolve_outcomes(sig, none, bars, F.lit(ts("2024-03-04T17:35:00"))).collect()
    assert early.count() == 0 and len(done) == 1 and done[0].stopped == 0
    assert done[0].exit_ts.timestamp() == ts("2024-03-04T17:30:00").timestamp()


def test_dedupe_on_stream_equals_batch(spark, tmp_path):
    rows = [(i, "X", f"h{i % 5}", "", "s", ts(f"2024-03-04T15:{i:02d}:00"), ts(f"2024-03-04T16:{i:02d}:00")) for i in range(20)]
    df = spark.createDataFrame(rows, NEWS)
    for k, part in enumerate((df.filter("id % 2 = 1"), df.filter("id % 2 = 0"))):  # out of order
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    items = K.item_stream(spark, str(tmp_path / "in" / "*"), NEWS, "parquet", "*.parquet", files_per_batch=1).withColumn("news_hash", F.md5("headline"))
    got = K.run_available(K.once_only(items, "published_utc").select("news_hash"), str(tmp_path / "o"), "x")
    assert sorted(r.news_hash for r in got.collect()) == sorted(r.h for r in df.select(F.md5("headline").alias("h")).distinct().collect())


def test_counts_and_sightings_do_not_depend_on_files_or_their_order(spark, tmp_path):
    """One file, or eight in reverse order of time with two files a batch: late items count, and nothing is forgotten."""
    rows = [(i, "XY"[i % 2], f"h{i % 37}", "", "s", ts(f"2024-03-{1 + i % 28:02d}T{i % 24:02d}:{i % 60:02d}:00"), ts(f"2024-03-30T{i % 24:02d}:00:{i % 60:02d}")) for i in range(400)]
    rows.sort(key=lambda r: r[5], reverse=True)
    schema = "id int, ticker string, headline string, summary string, source string, published_utc timestamp, arrival timestamp"
    one, many = tmp_path / "one", tmp_path / "many"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(one / "part"))
    next((one / "part").glob("*.parquet")).rename(one / "items.parquet")
    for k in range(8):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(many / "items.parquet"))
    seen = []
    for folder in (one, many):
        def items():
            return K.table_stream(spark, str(folder), "items", schema, files_per_batch=2).withColumn("news_hash", F.md5("headline"))
        stories = K.counted(items(), str(tmp_path / f"s{folder.name}"), "n", lambda df: K.story_counts(df, "published_utc")).collect()
        fails = K.counted(items(), str(tmp_path / f"f{folder.name}"), "n", lambda df: K.failure_counts(df, "published_utc")).collect()
        first = K.first_sightings(items(), str(tmp_path / f"o{folder.name}"), "n", "arrival").collect()
        late = K.run_available(K.with_lag(items(), "published_utc", "arrival").select("id", "lag_minutes"), str(tmp_path / f"l{folder.name}"), "n").collect()
        assert sum(r.n for r in stories) == sum(r.n for r in fails) == len(late) == 400 and len(first) == 37
        seen.append((sorted(map(str, stories)), sorted(map(str, fails)), sorted(r.news_hash for r in first), sorted((r.id, r.lag_minutes) for r in late)))
    assert seen[0] == seen[1]


def test_streams_without_files_are_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    items = K.table_stream(spark, str(tmp_path / "none"), "items", "ticker string, t timestamp, news_hash string")
    assert K.run_available(items, str(tmp_path / "a"), "x").count() == 0
    assert K.counted(items, str(tmp_path / "b"), "x", lambda df: K.story_counts(df, "t")).count() == 0
    assert K.first_sightings(items, str(tmp_path / "c"), "x", "t").count() == 0
