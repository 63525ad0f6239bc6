from datetime import timedelta

from conftest import ts

from tidemark.operators.dataset import build_dataset

NEWS = "news_id int, ticker string, headline string, summary string, source string, published_utc timestamp"


def inputs(spark, least=500):
    days = [ts(f"2024-03-{d:02d}T06:00:00") for d in (4, 5, 6)]
    sessions = spark.createDataFrame([(d, d + timedelta(hours=16)) for d in days], "sess_start timestamp, sess_end timestamp")
    rows = []
    for i, d in enumerate(days):
        for m in range(960):
            p = 100 + (m % 37) * 0.1 + i
            rows.append(("AAA", d + timedelta(minutes=m), p, p + 0.2, p - 0.2, p + 0.05, 10))
            if i == 2 and m < least - 1:  # one regular bar short; the bars of the night don't count
                rows.append(("BBB", d + timedelta(minutes=m), p, p, p, p, 5))
    rows += [("BBB", days[0] - timedelta(minutes=m + 1), 1.0, 1.0, 1.0, 1.0, 1) for m in range(20)]
    bars = spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume long")
    bench = spark.createDataFrame([(d.date() - timedelta(days=1), 50.0 + i) for i, d in enumerate(days)], "d date, c double")
    universe = spark.createDataFrame([("AAA", "Alpha Corp", "X"), ("BBB", "Beta Corp", "X"), ("CCC", None, "Y")], "ticker string, name string, sector string")
    at = lambda h, m=0: ts(f"2024-03-06T{h:02d}:{m:02d}:30")
    news = spark.createDataFrame([
        (1, "AAA", "AAA gains on new product", None, "s", at(15)),
        (2, "AAA", "AAA  gains on new product!", None, "s", at(15, 4)),  # a copy
        (3, "AAA", "Markets are calm", "Alpha holds", "s", at(16)),  # in the summary only
        (4, "AAA", "Markets are calm today", "nothing", "s", at(16, 1)),  # not relevant
        (5, "BBB", "BBB gains", None, "s", at(8)),  # too few regular bars
        (6, "AAA", None, "AAA", "s", at(17)),
        (7, None, "AAA again", None, "s", at(17)),
        (8, "AAA", "AAA early", None, "s", ts("2024-03-04T07:00:30")),  # warm-up of the hourly bars
        (9, "CCC", "CCC gains", None, "s", at(9)),  # no bars at all
    ], NEWS)
    return news, bars, sessions, bench, universe


def test_flow_from_raw_items_to_events(spark):
    d = build_dataset(*inputs(spark), ["X", "Y"], keep=lambda df: df.checkpoint(), min_anchors=5)
    got = {r.news_id: r for r in d.events.collect()}
    assert sorted(got) == [1, 3]
    one = got[1]
    assert one.relevance_tier == 1 and got[3].relevance_tier == 2 and one.delay_sec == 30 and one.sect_X == 1.0
    assert one.entry_price == 100 + (541 % 37) * 0.1 + 2 and abs(one.fwd_ret - (one.exit_price / one.entry_price - 1)) < 1e-12
    assert one.event_id == f"AAA_{int(ts('2024-03-06T15:00:30').timestamp())}_0" and one.sigma > 0 and one.rsi is not None
    assert got[3].items_prior == 1.0 and abs(got[3].hours_since_prev - 1) < 1e-9  # the copy was not seen
    assert {r.ticker: (r.n_bars, r.enough) for r in d.tickers.collect()} == {"AAA": (2880, True), "BBB": (499, False), "CCC": (0, False)}
    steps = {r.step: r.n for r in d.funnel.collect()}
    assert steps == {"raw": 9, "complete": 7, "deduplicated": 6, "tier 1": 4, "tier 2": 1, "tier 3": 1, "relevant": 5, "aligned": 3, "featured": 2}
    c = d.checks.first()
    assert (c.n, c.n_entry_before_news, c.n_exit_not_after_entry, c.n_overnight) == (2, 0, 0, 0)


def test_flow_over_empty_tables(spark):
    news, bars, sessions, bench, universe = inputs(spark)
    d = build_dataset(news.limit(0), bars.limit(0), sessions, bench.limit(0), universe, ["X"], keep=lambda df: df.checkpoint())
    assert d.events.count() == 0 and {r.n for r in d.funnel.collect()} == {0}
    assert all(r.n_bars == 0 and not r.enough for r in d.tickers.collect())
