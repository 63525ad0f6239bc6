import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import centroids


def brute(rows, k, rounds, dims):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, v) for i, v in good if i is not None)[:k]]
    if not c:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        group = {}
        for _, v in good:
            group.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(group[j]) for col in zip(*group[j])] if j in group else x for j, x in enumerate(c)]
    at = [(i, *near(v)[::-1]) for i, v in good]
    per = {}
    for _, j, d in at:
        per[j] = per.get(j, 0) + d
    return [(i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in at]


def key(rows):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


def result(df, **options):
    return key(tuple(r) for r in centroids.summary(*centroids.cluster(df, **options)).collect())


@pytest.mark.parametrize("chunk", [7, 2048])
def test_against_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.standard_normal(6) + 3 * (i % 4)).tolist()) for i in range(300)]
    rows += [(5, rows[9][1])] * 20 + [(None, [0.5] * 6), (700, [-0.0] * 6), (701, [1e5, -1e5, 0.0, 0.0, 0.0, 1e-9])]
    rows += [(801, None), (802, []), (803, [1.0] * 5), (804, [None] + [1.0] * 5), (805, [float("nan")] * 6), (806, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, values string").repartition(3)
    assert result(df, dimensions=6, chunk_rows=chunk) == key(brute(rows, 8, 10, 6))


def test_empty_clusters_equal_centroids_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(12)] + [(20, [1.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for part in (rows, rows[:3], rows[-1:]):
        assert result(spark.createDataFrame(part, df.schema), dimensions=2) == key(brute(part, 8, 10, 2))
    assert result(df.limit(0), dimensions=2) == [] == result(df, dimensions=3)
    assert result(df.selectExpr("null as vec_id", "embedding"), dimensions=2) == []


def test_values_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        centroids.cluster(df, dimensions=2)


def test_tables_hold_occurring_values_only():
    import pyarrow as pa

    codes = np.array([[5, -3], [5, 100_000], [7, -3]])
    (ids, values, places), = centroids._chunks([centroids.pack(pa.array([1, 2, 3]), codes)])
    assert [v.tolist() for v in values] == [[5, 7], [-3, 100_000]] and places.tolist() == [[0, 0, 1], [0, 1, 0]]
    label, distance = centroids.assign(values, places, np.array([[0, 0], [7, -3], [7, -3]]))
    assert label.tolist() == [1, 0, 1] and distance.tolist() == [4, 25 + 100_000**2, 0]
