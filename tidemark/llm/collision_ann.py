"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

Each shard of vectors is cut into bands of like norm, the longest first. A band's vectors are lengthened by one component
so that all have the norm of its longest; the largest inner product is then the least distance. One long vector so changes
the scale of its own band only. A band projects its vectors on `projections` random lines and keeps one sorted array per
line; a band of EXACT_ROWS or fewer is verified whole, whatever its norms. A query leaves out the bands whose longest
norm, times its own, is below the k-th score it has found: they can't hold a better one. A query's window on a line is centred on its own projection and bounded by binary search. Vectors are verified with their
exact inner product if the number of windows that hold them reaches a collision threshold: the highest one that `k`
vectors and the share `verify` of the band reach. While that threshold is below the share `collisions` of the lines,
virtual rehashing widens all windows by a factor; as they grow without limit, a band ends in any case. The best of all
bands and shards are merged.

Every vector is indexed, none is sampled. The query set is a stated one, against all rows: shards of bounded size meet
blocks of queries of bounded size, one pair a task, and each pair gives k rows per query.

On random directions in 64 dimensions (a hard case: neighbours are hardly nearer than others) the defaults find more than
0.95 of the true 20 nearest and verify a fifth of the vectors.

Vectors that are null, zero, or hold a null or non-finite component take no part, as queries or as candidates, nor do
those whose dimension is not the most frequent one (the larger one if two are). A query's own row is every row with its
id; a query id that is repeated is asked once, with the smallest of its vectors. Repeated candidate rows each count.
Null ids are neither queries nor candidates. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

PROJECTIONS = 96
COLLISIONS = 0.5
VERIFY = 0.2
FIRST_WINDOW = 1.6
GROWTH = 1.2
#: Longest by shortest norm of a band.
NORM_RATIO = 1.05
EXACT_ROWS = 256
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096


class CollisionIndex:
    """Sorted projections of a band's vectors, lengthened to the norm `longest`."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        extra = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        at = np.column_stack([vectors, extra]) @ self.lines / longest
        order = np.argsort(at, axis=0, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=0).T.copy()  # one row per line
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(ids))[:, None], axis=0)
        self.place = place.T.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)  # each vector's place in the sorted array

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each query's window on each line."""
        low = np.column_stack([s.searchsorted(at[:, j] - half) for j, s in enumerate(self.sorted)])
        high = np.column_stack([s.searchsorted(at[:, j] + half, "right") for j, s in enumerate(self.sorted)])
        return low, np.minimum(high - low, np.iinfo(self.place.dtype).max)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, collisions: float = COLLISIONS, verify: float = VERIFY, first_window: float = FIRST_WINDOW, growth: float = GROWTH):
        """Per query the ids and inner products of its k best verified vectors, best first."""
        lines, n = self.place.shape
        enough = int(np.ceil(collisions * lines))
        wanted = min(n, k + 1 + int(verify * n))  # the query's own row may be among them
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (queries / norms[:, None]) @ self.lines[:-1]
        kind = self.place.dtype
        gap, inside = np.empty(n, kind), np.empty(n, bool)
        first = self._windows(at, first_window)
        for q in range(len(queries)):
            half, (low, width) = first_window, (w[q] for w in first)
            while True:
                counts = np.zeros(n, np.uint8 if lines < 256 else np.uint16)
                for place, a, w in zip(self.place, low, width, strict=True):
                    if w:
                        # Places a..a + w - 1 of the sorted array are in the window: one unsigned comparison.
                        np.subtract(place, kind.type(a), out=gap)
                        np.less(gap, kind.type(w), out=inside)
                        counts += inside.view(np.uint8)
                # The highest threshold that enough vectors reach; windows widen while it is below the least one.
                reach = np.cumsum(np.bincount(counts, minlength=lines + 1)[::-1])[::-1]
                threshold = int(np.flatnonzero(reach >= wanted)[-1])
                if threshold >= enough:
                    break
                half *= growth
                low, width = (w[0] for w in self._windows(at[q : q + 1], half))
            pick = np.flatnonzero(counts >= threshold)
            pick = pick[self.ids[pick] != query_ids[q]]
            yield _best(self.ids, self.vectors, pick, queries[q], k)


class Exact:
    """A band that is verified whole."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, **_):
        for i, q in zip(query_ids, queries, strict=True):
            yield _best(self.ids, self.vectors, np.flatnonzero(self.ids != i), q, k)


def _best(ids: np.ndarray, vectors: np.ndarray, pick: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best of the picked vectors, best first."""
    score = np.einsum("ij,j->i", vectors[pick], query)
    if len(pick) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        pick = pick[score >= least - 1e-9 * (1 + abs(least))]
    score = (vectors[pick] * query).sum(axis=1)  # row by row alike: equal vectors have equal scores
    order = np.lexsort((ids[pick], -score))[:k]
    return ids[pick[order]], score[order]


def bands(norms: np.ndarray, ratio: float = NORM_RATIO, least: int = EXACT_ROWS) -> list[np.ndarray]:
    """Rows by falling norm, cut where a norm is below its band's longest by the ratio, but not below `least` rows."""
    order = np.argsort(-norms, kind="stable")
    falling, out, a = -norms[order], [], 0
    while a < len(order):
        b = int(np.searchsorted(falling, falling[a] / ratio, "right"))
        b = max(b, min(a + least, len(order)))
        out.append(order[a:b])
        a = b
    return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, projections: int = PROJECTIONS, **search) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and inner products of the k best vectors found in all bands, best first."""
    norms, asked = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (vectors, queries))
    found = [(ids[:0], np.zeros(0))] * len(queries)
    kth = np.full(len(queries), -np.inf)
    for band in bands(norms):
        longest = norms[band[0]] * (1 + 1e-12)
        left = np.flatnonzero(longest * asked * (1 + 1e-9) >= kth)
        if not len(left):
            break
        index = Exact(ids[band], vectors[band]) if len(band) <= EXACT_ROWS else CollisionIndex(ids[band], vectors[band], longest, projections)
        for q, (i, s) in zip(left, index.search(query_ids[left], queries[left], k, **search), strict=True):
            i, s = np.concatenate((found[q][0], i)), np.concatenate((found[q][1], s))
            order = np.lexsort((i, -s))[:k]
            found[q] = i[order], s[order]
            if len(order) == k:
                kth[q] = s[order[-1]]
    return found


def _valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, **search) -> DataFrame:
    """Per query its k nearest: query_id, rank, vec_id, score."""
    rows = keep(_valid(df, id_column, vector), "vectors")
    spark = rows.sparkSession
    asked = _valid(queries, id_column, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    out = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    asked = keep(asked.where(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    shards = -(-sizes["n"] // shard_rows)
    blocks = max(1, -(-asked.count() // block_queries))
    # (shard, block) pairs: a vector goes to its shard's pairs, a query to its block's.
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def matrix(t: pa.Table) -> np.ndarray:
        return np.asarray(t.column("v").combine_chunks().values, np.float64).reshape(t.num_rows, -1)

    def search_pair(vectors: pa.Table, block: pa.Table) -> pa.Table:
        if not vectors.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = block.column("vec_id").to_numpy()
        found = search_shard(vectors.column("vec_id").to_numpy(), matrix(vectors), ids, matrix(block), k, **search)
        return pa.table({"query_id": pa.array(np.repeat(ids, [len(x) for x, _ in found])), "vec_id": pa.array(np.concatenate([x for x, _ in found])), "score": pa.array(np.concatenate([s for _, s in found]))})

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search_pair, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
