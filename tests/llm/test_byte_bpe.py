import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe
from tidemark.llm.common import byte_view

TEXTS = [
    "The quick brown fox, it's 42!!", None, "", "  ", "\n\n", " \n x", "a  b", "a \tb", "\t\ta", "x   ", "don't DON'T we'll 'll''s '' 'sO 'rest 've' 'r 'l", "it's's's", "!'s 's", "é É ́x",
    "日本語のテキスト 한국어 ١٢٣", "ciónñ  ñezll\r\n\r\n", "🙂 🙂🏽 \x00nul", "　  wide line\x1c\x1d\u0085q", "<|endoftext|> x", "\U00010d40Ɤ \U0001e5d0", "ab" * 500 + " " * 300 + "\n" + "=" * 700 + "word " * 500, "'", "x'", "x'l", "' s",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, library):
    e = byte_bpe.encoder(byte_bpe.default_vocabulary())
    flat, offsets = byte_view(pa.array(texts, pa.large_string()))
    ids, at = e.encode(flat, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode_ordinary(t) for t in texts]
    data, cut = e.decode(ids, at)
    assert data.tobytes() == flat.tobytes() and (cut == offsets).all()


def test_texts_like_the_library(library):
    check([t or "" for t in TEXTS], library)
    check([t for t in TEXTS if t][::-1] * 3, library)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevmdlaZ  \n\t !1-é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_any_text_like_the_library(library, texts):
    check(texts, library)


def test_every_code_point_like_the_library(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(["".join(f"a{chr(c)}'s" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)], library)


def test_scan_composes_in_any_cut(monkeypatch):
    rng = np.random.default_rng(0)
    codes, compose, after, _ = byte_bpe.automaton()
    assert len(compose) < 256
    f = codes[rng.integers(0, 16, 3000)]
    want, state = [], 0
    for c in f:
        want.append(state)
        state = after[c, state]
    for block in (2, 3, 64, 5000):
        monkeypatch.setattr(byte_bpe, "BLOCK", block)
        assert after[byte_bpe.scan(f, compose), 0].tolist() == want


def test_merges_agree(library):
    e = byte_bpe.encoder(byte_bpe.default_vocabulary())
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(alphabet), n).tolist()) for n in (2, 3, 8, 9, 10, 32, 33, 63, 64) for alphabet in (b"ab", b" etaoin", bytes(range(256))) for _ in range(20)]
    merged = {}
    for of, counts, ids in e.pairs.merge(pieces):
        merged.update(zip(of.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True))
    assert sorted(merged) == list(range(len(pieces)))
    for i, p in enumerate(pieces):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            best = min(((e.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in e.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert merged[i].tolist() == byte_bpe._merge_heap(p, e.ranks) == [e.ranks[x] for x in parts]


def test_long_text_is_whole(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 1000)
    check(["word it's 12 " * 50_000 + "x" * 100_000 + "\n" * 5000], library)


def test_full_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    check([t or "" for t in TEXTS], library)


def test_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "again"), (4, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, ids int, n_tokens string").repartition(3)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(key, map(tuple, byte_bpe.round_trip(df).collect()))) == sorted(map(key, want))
    assert byte_bpe.round_trip(df.limit(0)).count() == 0
    kept = byte_bpe.encode(df)
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids"]
    got = byte_bpe.decode(kept.withColumnRenamed("text", "was")).collect()
    assert len(got) == len(rows) and all(bytes(r.text).decode() == (r.was or "") and list(r.ids) == library.encode_ordinary(r.was or "") for r in got)


def test_invalid_bytes_read_as_replacement(spark, library):
    df = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    r = byte_bpe.round_trip(df).first()
    assert r.decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
