import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity
from tidemark.llm.common import byte_view


def data(seed=1, n=3000):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("an", "er", "tio", "és") for b in ("st", "ou", "ing") for c in ("a", "re", "wh", "ti", "ly")]
    bad = ["moron", "Trash,", "scum", "loweian", "loweier", "loweiou", "loweist"]
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        toxic = rng.random() < 0.12
        for w in rng.choices(bad, k=3) if toxic else ():
            words.insert(rng.randrange(len(words) + 1), w)
        docs.append((i, " ".join(words), "en", "s", 0.5))
        truth[i] = toxic
        if rng.random() < 0.4:
            labels.append((i, 1, int(toxic)))
    return docs, labels, truth


SCHEMA = "doc_id long, text string, lang string, source string, score double"


def test_held_out_accuracy(spark):
    docs, labels, truth = data()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(r.score, truth[r.doc_id]) for r in rows if r.held_out]
    good = np.mean([(s >= 0.5) == y for s, y in out])
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    assert good > 0.95 and np.mean([p > q for p in pos for q in neg]) > 0.97

    # Labels of held-out rows are not used: turning them over changes nothing.
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    again = toxicity.toxicity(df, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}

    kept = toxicity.reject(df, marks)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_odd_rows(spark):
    docs, labels, _ = data(2, 600)
    docs += [(9000, None, None, None, None), (9001, "", "", "", 0.1), (9002, " \n ", "", "", 0.1), (None, "moron scum trash", "", "", 0.1), (docs[0][0], docs[0][1], "x", "y", 0.2), (9003, "moron scum trash loweian " * 20_000, "", "", 0.0)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = {}
    for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert all(rows[i][0].predicted == 0 for i in (9000, 9001, 9002))
    assert rows[None][0].held_out is False and rows[9003][0].predicted == 1
    assert len(rows[docs[0][0]]) == 2


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", "", "", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(df, none).collect()] == [0]
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["...moron!", "", "!!!", "é", "Éa éabcdef.", " x ", "(y)", "abcdef", "-", "日本語のテ "]
    def of(some):
        flat, offsets = byte_view(pa.array(some, pa.large_string()))
        ids, at = toxicity.features(flat, offsets)
        return [set(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert of(texts) == [of([t])[0] for t in texts]
    assert of(["moron"]) == of(["(MORON)"]) and of(["!!!"]) == [set()] == of([""])


def test_shares_of_labelled_and_unlabelled_rows_differ(spark):
    docs, _, truth = data(3)
    rng = random.Random(4)
    # Hot source: copies of toxic rows with other plain words, without labels.
    bad = [t for i, t, *_ in docs if truth[i]]
    for i in range(3000, 4200):
        words = rng.choice(bad).split()
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "hot", 0.5))
        truth[i] = True
    df = spark.createDataFrame(docs, SCHEMA)
    labels = [(i, int(truth[i])) for i in range(3000) if rng.random() < 0.5]
    for marks in (labels, [x for x in labels if x[1]]):  # all, and confirmed toxic rows only
        rows = toxicity.toxicity(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        recall = np.mean([r.predicted for r in rows if truth[r.doc_id]])
        wrong = np.mean([r.predicted for r in rows if not truth[r.doc_id]])
        assert recall > 0.95 and wrong < 0.03, (recall, wrong)


def test_rare_markers_count_at_every_sample_size():
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ar", "tio", "un", "ke") for b in ("st", "ou", "ing", "lla", "mo")]
    markers = ["".join(rng.choices("bcdfghjklmnpqrvwxz", k=7)) for _ in range(30)]  # each in a thirtieth of the toxic texts

    def sample(n, toxic):
        texts = [" ".join([*rng.choices(plain, k=30), *([rng.choice(markers)] if rng.random() < toxic else [])]) for _ in range(n)]
        return toxicity.Features(*toxicity.features(*byte_view(pa.array(texts, pa.large_string()))))

    for n in (900, 1600):
        model = toxicity.NNPU(0.1).fit(sample(n, 1), sample(4000, 0.1))
        seen, clean = sample(500, 1), sample(500, 0)
        scores = model.margin(seen.ids, seen.at), model.margin(clean.ids, clean.at)
        assert np.mean([p > q for p in scores[0][:200] for q in scores[1][:200]]) > 0.95


@pytest.mark.parametrize("positives", [0, 1, 5, 10, 50])
def test_few_positives_leave_clean_documents(spark, positives):
    docs, _, truth = data(6, 300 if positives < 50 else 900)
    toxic = [i for i, _, *_ in docs if truth[i] and zlib.crc32(str(i).encode()) % 5][:positives]
    clean = [i for i, _, *_ in docs if not truth[i]][: 4 * positives + 20]
    marks = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in clean], "doc_id long, toxic int")
    rows = toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), marks).collect()
    wrong = np.mean([r.predicted for r in rows if not truth[r.doc_id]])
    # With five or ten confirmed texts the scores tell little; no more than half of the labelled share is taken wrongly.
    assert wrong <= (0.03 if positives in (0, 1, 50) else 0.1) and len(rows) == len(docs)
    if positives == 50:
        assert np.mean([r.predicted for r in rows if truth[r.doc_id]]) > 0.8


def test_fully_labelled_table_and_clashing_names(spark):
    docs, _, truth = data(7, 1500)
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("score", "_toxicity").withColumnRenamed("lang", "__TOXICITY")
    marks = spark.createDataFrame([(i, int(t)) for i, t in truth.items()], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    out = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert len({s for s, _, _ in out}) > 10 and np.mean([p == y for _, y, p in out]) > 0.95
    kept = toxicity.reject(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}
