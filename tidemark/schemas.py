"""Explicit schemas: nothing is inferred from data files."""

from __future__ import annotations

NEWS_RAW = (
    "category string, datetime bigint, headline string, id bigint, source string, summary string, url string"
)
NEWS_ARTICLE = (
    "id bigint, headline string, summary string, author string, source string, url string, "
    "created_at string, symbols array<string>"
)
BAR_CSV = "t timestamp, o double, h double, l double, c double, v bigint, n bigint, vw double"
BAR_NAMES = {
    "t": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "n": "trade_count", "vw": "vwap",
}
DAILY_JSON = "array<struct<t:timestamp,o:double,h:double,l:double,c:double,v:double>>"
CALENDAR = "date string, open string, close string"
CORPORATE_ACTIONS = (
    "corporate_actions map<string, array<struct<symbol:string,source_symbol:string,new_symbol:string,"
    "ex_date:string,new_rate:double,old_rate:double,source_rate:double>>>"
)
FILING_COLUMNS = [
    "ACCESSION_NUMBER", "FILING_DATE", "PERIOD_OF_REPORT", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME",
    "ISSUERTRADINGSYMBOL", "AFF10B5ONE",
]
FILING_LINE_COLUMNS = ["ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE"]
FILING_OWNER_COLUMNS = ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE"]
HOLDING_XML = (
    "name string, cusip string, balance string, valUSD string, pctVal string, assetCat string"
)

# Append-only log tables, all partitioned by `day`.
LOGS = {
    "signals": (
        "signal_id bigint, ts_utc timestamp, ticker string, class_name string, prob_calibrated double, "
        "prob_raw double, severity_score double, severe int, entry_price double, entry_source string, "
        "stop_price double, headline string, url string, status string, suppress_reason string, "
        "news_source string, dedup_group_id string, n_symbols int"
    ),
    "outcomes": (
        "signal_id bigint, exit_ts timestamp, exit_price double, stopped int, ret_gross double, "
        "ret_net double, filled_at timestamp"
    ),
    "seen_news": "news_hash string, ticker string, first_seen_utc timestamp",
    "poll_failures": "ts_utc timestamp, ticker string, error string",
    "stale_rejections": (
        "ts_utc timestamp, ticker string, headline string, published_utc timestamp, age_minutes double"
    ),
    "retrieval_lag": (
        "ts_utc timestamp, ticker string, headline string, published_utc timestamp, lag_minutes double, "
        "rejected_stale int"
    ),
    "feed_articles_seen": (
        "article_id bigint, ticker string, ts_utc timestamp, headline string, author string, source string, "
        "created_at timestamp, lag_minutes double"
    ),
    "signal_insert_log": (
        "logged_at_utc timestamp, ts_utc timestamp, ticker string, class_name string, headline string, "
        "url string, status string"
    ),
}

# The tables this repository is checked on. Timestamps are stored without a zone and mean UTC.
TEST_TABLES = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
}
