import zlib

import numpy as np
import pytest

from tidemark.llm import token_counts, token_files
from tidemark.llm.token_files import EliasFano
from tidemark.llm.tokenize import WordEncoder, default_vocabulary

TEXTS = [
    "The quick brown fox, it's 42!!", None, "", "  ", "\n\n", "Ünïcode É tail\tTab\x0bvt\x1cfs　wide line", "é É ́x",
    "special <|endoftext|> and <|ENDOFTEXT|> x<|startoftext|>y", "ΣΑΣ İstanbul ﬁ ǅ", "日本語のテキスト 한국어", "a.,b ... 's 'S don't DON'T", "🙂 🙂🏽 \x00nul", "word " * 500,
]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_encoder_is_the_tokenizer():
    import pyarrow as pa

    t = tokenizer()
    for cache in (1_000_000, 3):
        e = WordEncoder(default_vocabulary(), cache)
        for texts in (TEXTS, TEXTS[::-1], ["New words, Each time"]):
            texts = [x or "" for x in texts]
            ids, at = e.encode(pa.array(texts, pa.large_string()).slice(0))
            want = [t.encode(x, add_special_tokens=False).ids for x in texts]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


@pytest.mark.parametrize("values", [[], [0], [5], [1, 1, 1], list(range(1, 2000, 3)), [0] * 600 + [10**9], np.cumsum(np.random.default_rng(0).integers(1, 5000, 3000)).tolist()])
def test_elias_fano(values):
    e = EliasFano.from_bytes(EliasFano.build(np.array(values, np.int64)).to_bytes())
    assert e.select(0, len(values)).tolist() == values
    for a, b in ((0, 1), (1, 2), (255, 258), (256, 257), (500, len(values)), (len(values) - 1, len(values))):
        if 0 <= a < b <= len(values):
            assert e.select(a, b).tolist() == values[a:b]
    if len(values) > 500:
        n, u = len(values), values[-1]
        assert len(e.to_bytes()) * 8 < n * (2 + max(0, np.log2(u / n)) + 1) + 1000


def test_token_files(spark):
    rows = [(i * 2, t) for i, t in enumerate(TEXTS)] + [(4, "again"), (None, "no id"), (1, "x " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, shard int, docs string").repartition(3)
    got = token_files.token_files(df).collect()
    t, end = tokenizer(), token_files.END_ID
    enc = {(d, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for d, x in rows}
    want = sorted((-1 if d is None else d, len(v), zlib.crc32(v.tobytes())) for (d, _), v in enc.items())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, -2
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) >= last
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(df).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(df)).count() == 0


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    t = tokenizer()
    texts = TEXTS * 3 + ["a b c d e f"] * 40 + ["x y"] * 7
    n = np.array([len(t.encode(x or "", add_special_tokens=False).ids) for x in texts])
    df = spark.createDataFrame([(x, 1) for x in texts], "text string, length int").repartition(4)
    sums = token_counts.suffix_sums(token_counts.histogram(df)).cache()
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(n.tolist())
    for k, r in got.items():
        assert (r.docs, r.docs_over, r.tokens_over) == ((n == k).sum(), (n > k).sum(), n[n > k].sum())
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(n), n.sum(), np.minimum(n, k).sum())
        assert r.share_within == pytest.approx((n <= k).mean())
    limits = [0, 1, 5, 7, 100, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert (r.docs_over, r.truncated_total) == ((n > r.context_limit).sum(), np.minimum(n, r.context_limit).sum())
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.length == np.sort(n)[int(np.ceil(r.share * len(n))) - 1]
