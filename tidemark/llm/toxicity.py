"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier is trained in numpy from confirmed toxic texts (positive) and texts without a label (unlabelled,
some of them toxic). The risk corrects for the class prior pi: pi R_p(+) + max(0, R_u(-) - pi R_p(-)); while the second
part of a batch is negative, the step goes the other way, so that the classifier can't learn that known positives in the
unlabelled text are negative. pi is the `prior` given, or else estimated from the unlabelled texts: toxic and clean rows
may be labelled at any shares, and labels may hold toxic rows only. One classifier is trained per fold of both samples
and scores the fold it has not seen. These scores give pi, and the cut that makes the non-negative risk, counted in
errors, least; it becomes the score 0.5 of the mean of the classifiers. Where the scores don't bound pi (few positives, or
no feature that tells them apart) pi is the toxic share of the labelled rows, and no more than half of the unlabelled
texts lie above the cut. A clean label is not read by the classifier: every training row that is not confirmed toxic is
unlabelled, so a fully labelled table works as any other.

Features are a text's distinct words (trimmed of punctuation) and their first 3, 4 and 5 characters, hashed; a feature
counts once per text and is weighted by how unevenly it is spread over both samples (none if the difference is within
LEAST_Z standard errors, or if fewer than four texts hold it). Nothing but the text is an input.

Bounded: at most MAX_POSITIVE and MAX_UNLABELLED training texts, taken by hash of doc_id, are fitted in one task, which
reads their hashed features from the shared folder; the driver gets the weights. Every row is scored over its whole text, in Arrow batches; weights (one float per hashed feature) are broadcast.

Null and empty texts get the score of a text without features, which is held below 0.5 (not toxic). Labels of a doc_id that
is repeated in `labels` count as toxic if any is; null labels are no labels. Without a positive or an unlabelled training
text every score is the prior given, or else the share of toxic rows among the labelled training rows, held below 0.5.
Very long texts are one numpy pass each. Columns of the input may have any names. Null doc_ids are not held out and carry no label. Other columns are ignored or kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Prefixes, each_text, free_name, keep, mix, words

MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
FOLDS = 5
BITS = 20
LENGTHS = (3, 4, 5)
#: Standard errors between both samples' shares from which a feature has a weight, whatever the sample sizes.
LEAST_Z = 3.0
_TRIM = np.zeros(256, bool)
_TRIM[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def features(flat: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of the texts: ids, and the n + 1 offsets of the texts into them."""
    starts, stops, at = words(flat, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    last = len(flat) - 1
    while (cut := (starts < stops) & _TRIM[flat[np.minimum(starts, last)]]).any():  # trim punctuation at both ends
        starts = starts + cut
    while (cut := (starts < stops) & _TRIM[flat[stops - 1]]).any():
        stops = stops - cut
    doc = np.repeat(np.arange(n), np.diff(at))
    hashes = Prefixes(flat, fold_case=True)
    # Characters start at bytes other than 10xxxxxx; a prefix of k characters ends where character k + 1 begins.
    begins = np.flatnonzero((flat & 0xC0) != 0x80)
    nth = np.searchsorted(begins, starts)
    codes = []
    full = starts < stops
    codes.append((doc[full], mix(hashes.of(starts[full], stops[full]) + np.uint64(1))))
    for k in LENGTHS:
        end = begins[np.minimum(nth + k, len(begins) - 1)]
        ok = full & (nth + k < len(begins)) & (end < stops)
        codes.append((doc[ok], mix(hashes.of(starts[ok], end[ok]) + np.uint64(k))))
    d = np.concatenate([x for x, _ in codes])
    f = np.concatenate([y for _, y in codes]) >> np.uint64(64 - bits)
    both = np.sort(d.astype(np.uint64) << np.uint64(bits) | f)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    doc = (both >> np.uint64(bits)).astype(np.int64)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(doc, np.arange(n + 1))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Features:
    """Feature ids of texts, one after the other, and the offsets of the texts."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.ids, self.at = ids, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def only(self, wanted: np.ndarray) -> Features:
        kept = wanted[self.ids]
        return Features(self.ids[kept], np.concatenate(([0], np.cumsum(kept)))[self.at])

    def take(self, pick: np.ndarray) -> Features:
        return Features(self.rows(pick)[0], np.concatenate(([0], np.cumsum(self.at[pick + 1] - self.at[pick]))))

    def rows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the picked texts, and which pick each belongs to."""
        n = self.at[pick + 1] - self.at[pick]
        of = np.repeat(np.arange(len(pick)), n)
        return self.ids[np.arange(len(of)) + np.repeat(self.at[pick] - (np.cumsum(n) - n), n)], of


class NNPU:
    """Weights of a linear classifier over hashed features and its bias."""

    def __init__(self, prior: float, bits: int = BITS):
        self.prior, self.bits = prior, bits
        self.weights = np.zeros(1 << bits, np.float32)
        self.bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))

    def fit(self, positive: Features, unlabelled: Features, epochs: int = 12, batch: int = 512, rate: float = 0.03, decay: float = 1e-5, least_z: float = LEAST_Z, seed: int = 7) -> NNPU:
        size, n_p, n_u = 1 << self.bits, len(positive), len(unlabelled)
        p_count, u_count = (np.bincount(x.ids, minlength=size) for x in (positive, unlabelled))
        # Scale of a feature: how far its share in positives is from that in unlabelled texts, in standard errors.
        p, u = (p_count + 0.5) / (n_p + 1), (u_count + 0.5) / (n_u + 1)
        z = np.abs(p - u) / np.sqrt(p * (1 - np.minimum(p, 0.999)) / n_p + u * (1 - np.minimum(u, 0.999)) / n_u)
        scale = np.where((p_count + u_count >= 4) & (z > least_z), np.minimum(z / 10, 1.0), 0).astype(np.float32)
        x_p, x_u = positive.only(scale > 0), unlabelled.only(scale > 0)
        # Only features with a weight are trained, under new numbers.
        active = np.flatnonzero(scale)
        number = np.zeros(size, np.int32)
        number[active] = np.arange(len(active))
        x_p, x_u, scale, size = Features(number[x_p.ids], x_p.at), Features(number[x_u.ids], x_u.at), scale[active], len(active)
        rng = np.random.default_rng(seed)
        w, m, v = np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32)
        b, mb, vb, step = self.bias, 0.0, 0.0, 0
        half = batch // 2
        for _ in range(epochs):
            order = rng.permutation(n_u)
            for a in range(0, n_u, half):
                pu, pp = order[a : a + half], rng.integers(0, n_p, half)
                (fu, iu), (fp, ip) = x_u.rows(pu), x_p.rows(pp)
                gu = _sigmoid(np.bincount(iu, w[fu] * scale[fu], len(pu)) + b)  # score of the unlabelled
                gp = _sigmoid(np.bincount(ip, w[fp] * scale[fp], len(pp)) + b)
                pi = self.prior
                # Logistic loss: l(+) = -log g, l(-) = -log(1 - g).
                negative = -np.log1p(-np.minimum(gu, 1 - 1e-7)).mean() + pi * np.log1p(-np.minimum(gp, 1 - 1e-7)).mean()
                if negative >= 0:
                    du, dp = gu / len(pu), pi * (gp - 1) / len(pp) - pi * gp / len(pp)
                else:  # step against the negative part
                    du, dp = -gu / len(pu), pi * gp / len(pp)
                g = (np.bincount(fu, du[iu], size) + np.bincount(fp, dp[ip], size)).astype(np.float32) * scale + decay * w
                gb = float(du.sum() + dp.sum())
                step += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                mb += 0.1 * (gb - mb)
                vb += 0.001 * (gb * gb - vb)
                c1, c2 = 1 - 0.9**step, 1 - 0.999**step
                w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
                b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.weights[active], self.bias = w * scale, float(b)
        return self

    def margin(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
        return sums[at[1:]] - sums[at[:-1]] + self.bias

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = self.margin(ids, at)
        return _sigmoid(np.where(at[1:] == at[:-1], np.minimum(m, -1e-6), m))  # a text without features is not toxic


def _above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of the scores that reach each cut."""
    return 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)


def unlabelled_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float | None:
    """Share of positives among the unlabelled, from scores of texts that the model has not seen.

    Above every cut lie at least the share's own positives, so it is at most the ratio of both samples' shares above the
    cut; the cut with the least upper bound of that ratio (90 % of confidence) counts. None if no cut bounds it below one.
    """
    cuts = np.unique(positive)
    p, u = _above(positive, cuts), _above(unlabelled, cuts)
    margin = sum(np.sqrt(np.log(40) / 2 / len(x)) for x in (positive, unlabelled))
    bound = (u + 1.01 * margin) / p
    at = np.argmin(bound)
    if bound[at] >= 1:
        return None
    return float(min(max(u[at] / p[at], 1e-3), 0.999))


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut with the least non-negative risk in errors: pi P_p(below) + max(0, P_u(above) - pi P_p(above))."""
    values = np.unique(np.concatenate((positive, unlabelled)))
    cuts = np.concatenate((values[:1] - 1, (values[:-1] + values[1:]) / 2, values[-1:] + 1))
    p, u = _above(positive, cuts), _above(unlabelled, cuts)
    risk = prior * (1 - p) + np.maximum(0, u - prior * p)
    return float(np.median(cuts[risk <= risk.min() + 1e-12]))


def fit(positive: Features, unlabelled: Features, prior: float | None, fallback: float, bits: int = BITS) -> NNPU:
    """The mean of one classifier per fold; texts of a fold, scored by its classifier, give the prior and the cut."""
    folds = min(FOLDS, len(positive), len(unlabelled))
    if folds < 2:
        model = NNPU(fallback if prior is None else prior, bits).fit(positive, unlabelled)
        model.bias -= max(0.0, _over_half(model.margin(unlabelled.ids, unlabelled.at)))
        return model
    fold_p, fold_u = (np.random.default_rng(5).permutation(len(x)) % folds for x in (positive, unlabelled))

    def each_fold(pi: float) -> tuple[list[NNPU], np.ndarray, np.ndarray]:
        models, seen = [], ([], [])
        for k in range(folds):
            m = NNPU(pi, bits).fit(*(x.take(np.flatnonzero(f != k)) for x, f in ((positive, fold_p), (unlabelled, fold_u))))
            models.append(m)
            for out, x, f in zip(seen, (positive, unlabelled), (fold_p, fold_u), strict=True):
                part = x.take(np.flatnonzero(f == k))
                out.append(m.margin(part.ids, part.at))
        return models, *map(np.concatenate, seen)

    known = prior is not None
    if known:
        models, p, u = each_fold(prior)
    else:
        # Both are estimates from above: the less the scores of the two kinds overlap, the closer.
        first = unlabelled_prior(*each_fold(0.5)[1:])
        prior = fallback if first is None else first
        models, p, u = each_fold(prior)
        second = unlabelled_prior(p, u)
        known = first is not None and second is not None
        prior = min(x for x in (prior, second) if x is not None)
    model = NNPU(prior, bits)
    model.weights = np.mean([m.weights for m in models], axis=0)
    cut = least_risk(p, u, prior)
    model.bias = float(np.mean([m.bias for m in models])) - (cut if known else max(cut, _over_half(u)))
    return model


def _over_half(scores: np.ndarray) -> float:
    """The least cut that at most half of the scores reach."""
    return float(np.nextafter(np.sort(scores)[(len(scores) - 1) // 2], np.inf)) + 1e-6


def held_out(id_column: str = "doc_id"):
    """Whether labels of the row are kept from training: crc32 of the id as text divides by FOLDS."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(df: DataFrame, most: int, text: str, bits: int) -> DataFrame:
    """Hashed features (`f`, 32-bit ids) of some `most` texts, by hash of the id, kept in the shared folder."""
    n = df.count()
    if n > most:
        # A share of the hash range that holds `most` rows on average; the fit takes `most` of them.
        df = df.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.02 * most / n)))

    def encode(batches):
        for batch, flat, offsets in each_text(batches, text):
            ids, at = features(flat, offsets, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "f"])

    return keep(df.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(encode, "doc_id long, f binary"), "features")


def _fit_in_task(positive: DataFrame, unlabelled: DataFrame, most: tuple[int, int], prior: float | None, fallback: float, bits: int) -> NNPU:
    """The fit over both bounded samples, in one task; the weights come back."""

    def run(batches):
        rows: tuple[list, list] = ([], [])
        for batch in batches:
            for kind, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(rows[kind]) < most[kind]:
                    rows[kind].append(np.frombuffer(f.as_buffer(), np.int32).copy())
        both = [Features(np.concatenate([*x, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(v) for v in x], dtype=np.int64)))) for x in rows]
        rows[0].clear(), rows[1].clear()
        if not len(both[0]) or not len(both[1]):
            model = NNPU(fallback if prior is None else prior, bits)
            model.bias = model.bias if prior is not None else min(model.bias, -1e-6)
        else:
            model = fit(*both, prior, fallback, bits)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([float(model.bias)]), "prior": pa.array([float(model.prior)])})

    tagged = positive.select(F.lit(0).alias("k"), "doc_id", "f").unionAll(unlabelled.select(F.lit(1).alias("k"), "doc_id", "f"))
    # One task over a bounded sample, in a fixed order.
    ordered = tagged.repartition(1).sortWithinPartitions("k", "doc_id", "f").select("k", "f")
    row = ordered.mapInArrow(run, "weights binary, bias double, prior double").first()
    if row is None:
        return _unfitted(prior, fallback, bits)
    model = NNPU(row.prior, bits)
    model.weights, model.bias = np.frombuffer(row.weights, "<f4"), row.bias
    return model


def _unfitted(prior: float | None, fallback: float, bits: int) -> NNPU:
    """Without texts of both kinds: the prior as every score, an estimated one below 0.5."""
    model = NNPU(fallback if prior is None else prior, bits)
    if prior is None:
        model.bias = min(model.bias, -1e-6)
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, bits: int = BITS, prior: float | None = None) -> NNPU:
    """Fit on the rows that are not held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label).alias("_y"))
    marks = marks.where(~held_out())
    by = {bool(r["t"]): r["n"] for r in marks.groupBy((F.col("_y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_all = by.get(True, 0), sum(by.values())
    share = min(max(n_toxic / n_all if n_all else 0.0, 1e-3), 0.999)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    few = keep(_thin(marks.where("_y > 0"), n_toxic, max_positive), "toxic")
    positive = _sample(texts.join(few.select("doc_id"), "doc_id", "left_semi"), max_positive, "text", bits)
    ids = docs.select(F.col(id_column).alias("doc_id")).where("doc_id is not null").where(~held_out()).distinct()
    # Labels of held-out rows play no part: unlabelled rows come from the training rows, those labelled clean among them.
    free = ids.join(marks.where("_y > 0").select("doc_id"), "doc_id", "left_anti")
    free = keep(_thin(free, free.count(), max_unlabelled), "unlabelled")
    unlabelled = _sample(texts.join(free, "doc_id", "left_semi"), max_unlabelled, "text", bits)
    return _fit_in_task(positive, unlabelled, (max_positive, max_unlabelled), prior, share, bits)


def _thin(df: DataFrame, n: int, most: int) -> DataFrame:
    return df if n <= most else df.where(F.pmod(F.xxhash64("doc_id", F.lit("thin")), F.lit(1 << 20)) < int((1 << 20) * most / n))


def score(df: DataFrame, model: NNPU, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every row's whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch, flat, offsets in each_text(batches, text):
            s = m.score(*features(flat, offsets, m.bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    model = train(docs, labels, id_column, text, **options)
    rows = score(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are not predicted to be toxic, with the columns of docs."""
    model = train(docs, labels, id_column, text, **options)
    name = free_name(docs, "_toxicity")
    return score(docs, model, text, name).where(F.col(name) < 0.5).drop(name)
