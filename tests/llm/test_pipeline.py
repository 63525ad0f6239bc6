import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute as near_duplicates
from test_ngram_join import grams

from tidemark.llm import mixing, toxicity
from tidemark.llm.tokenize import default_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
BAD = ["moron", "scumbag", "trashface", "loweian", "vermin"]


def corpus():
    """Made-up documents with known toxic texts, exact and near copies, and benchmark passages; labels; items."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8))) for _ in range(600)]
    docs, toxic, copies, leaks = [], set(), {}, set()
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(12)] + [(50, None), (51, "")]
    for i in range(900):
        w = rng.choices(words, k=rng.randint(60, 160))
        if i % 8 == 3:
            toxic.add(i)
            for b in rng.choices(BAD, k=4):
                w.insert(rng.randrange(len(w)), b)
        elif i % 10 == 7 and i > 20:
            of = max(d for d in range(i) if d not in toxic and d not in leaks and d not in copies)
            w = docs[of][1].split()
            if i % 20 == 7:
                w[len(w) // 2] = "changed"
            copies[i] = of
        elif i % 25 == 1:
            leaks.add(i)
            w[10:10] = items[i % 12][1].split()
        docs.append((i, " ".join(w), "en", f"src{i % 4}", 10))
    docs += [(None, None, None, None, None), (900_001, "", "xx", None, 0), (900_002, "", "xx", "src0", 0), (3, "repeated id", "xx", "src1", 11), (900_003, "very long " * 60_000 + docs[0][1], "en", "src2", 1)]
    labels = [(i, 1, int(i in toxic)) for i in range(900) if rng.random() < 0.6]
    return docs, labels, items, toxic, copies, leaks


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, labels, items, toxic, copies, leaks = corpus()
    folder = str(tmp_path_factory.mktemp("corpus"))
    for rows, schema, name in ((docs, DOCS, "documents"), (labels, "doc_id long, quality int, toxic int", "labels"), (items, "item_id long, text string", "benchmark")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return folder, toxic, copies, leaks


@pytest.fixture(scope="module")
def stages(spark, made):
    """Every stage's result, each over its predecessor's."""
    folder = made[0]
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.keep(stage(spark, out[-1], folder), f"test-{name}"))
    return [(df, [tuple(r) for r in df.collect()]) for df in out]


def test_every_stage_has_work(made, stages):
    """Known toxic texts, copies and passages leave; clean documents stay; no stage runs on next to nothing."""
    _, toxic, copies, leaks = made
    texts = [sum(1 for r in rows if r[1]) for _, rows in stages[:-1]]
    assert min(texts) >= 400 and len(stages[-1][1]) >= 400
    ids = [{r[0] for r in rows} for _, rows in stages[:-1]]
    clean = set(range(900)) - toxic
    assert len(toxic - ids[1]) >= 0.9 * len(toxic) and len(clean & ids[1]) >= 0.99 * len(clean)
    of = {i: o for i, o in copies.items() if {i, o} <= ids[1]}
    assert len(of) > 50 and not set(of) & ids[2] and ids[2] >= (clean & ids[1]) - set(of)
    assert leaks & ids[2] and not leaks & ids[3] and ids[3] >= (clean & ids[2]) - leaks


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert all(df.columns == COLUMNS for df, _ in stages[:-1])


def test_toxicity(spark, made, stages):
    docs, kept = stages[0][0], Counter(stages[1][1])
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{made[0]}/labels.parquet")).collect()
    assert sum(1 - r.predicted for r in scored) == sum(kept.values()) < len(scored)
    assert {r.doc_id for r in scored if not r.predicted} == {r[0] for r in kept}


def test_near_duplicates(stages):
    rows = [r[:2] for r in stages[1][1]]
    want, _, _ = near_duplicates(rows)
    classes = {c for _, n, c in want if n}
    got = [r for r in stages[2][1] if grams(r[1])]
    assert sorted(r[0] for r in got) == sorted(classes)
    assert sum(not grams(r[1]) for r in stages[2][1]) == sum(not grams(t) for _, t in rows)


def test_decontamination(spark, made, stages):
    items = [grams(r.text) for r in spark.read.parquet(f"{made[0]}/benchmark.parquet").collect()]
    clean = [r for r in stages[2][1] if not any(10 * len(i & grams(r[1])) >= 8 * len(i) for i in items if i)]
    assert Counter(clean) == Counter(stages[3][1])


def test_mixing(stages):
    plan = mixing.plan(stages[3][0]).collect()
    assert sorted(Counter(stages[4][1]).values()) == sorted(r.copies for r in plan if r.copies)
    assert set(stages[4][1]) <= set(stages[3][1])


def test_token_files(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    want = []
    for d, text, *_ in stages[4][1]:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((-1 if d is None else d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-1 if d is None else d, n, c) for d, _, n, c in stages[5][1]) == sorted(want)


def test_empty_table(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, made[0])
    assert docs.count() == 0


def test_clashing_column_names(spark, made):
    names = ["_toxicity", "__hits", "_hits", "hits", "HITS_"]
    docs = spark.read.parquet(f"{made[0]}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.col("doc_id").alias(n) for n in names])
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, made[0])
        assert out.columns == docs.columns and out.where(" or ".join(f"`{n}` <> doc_id" for n in names)).count() == 0 < out.count()


def test_smallest_table_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, folder).collect()}
    clean = {r.doc_id for r in docs.collect()} - toxic
    assert len(kept & clean) >= 0.9 * len(clean)
