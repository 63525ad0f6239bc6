"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, floor(scale * x). Vectors are packed into chunks of bounded size, dimension by dimension: the
integer values that occur in a chunk, ascending, and for every vector the place of its own value among them. In each
round a task tabulates, for each dimension, the squared difference of every occurring value to every centroid; the
distances of all vectors of the chunk are then gathers from these tables and sums, without any arithmetic on vectors.
All of it is in 64-bit integers, so rounds are exact and reruns agree whatever the partitioning.

A round is one pass over the packed table, which is written once to the shared folder; each task returns one count and
one sum per dimension and cluster. The driver holds the centroids alone. Rounds end early once no centroid moves: the
rest would change nothing.

Kept are vectors with exactly `dimensions` components, none null, NaN or infinite; the others take no part and give no
row. Centroids start as the `clusters` kept vectors with the smallest lowercase-hex sha256 of `<seed>:<id>`, in that
order (equal ids: the smaller vector first; vectors without an id are no start). With fewer vectors there are fewer
centroids; without any that has an id, the result is empty. Ties go to the centroid with the smaller number, equal
centroids included. An empty cluster keeps its centroid. Repeated rows count and come back as often as they are there,
null ids as null. Components so large that a squared distance could pass 64 bits (beyond 2^28 for 64 dimensions) are an
error, as no answer in 64 bits exists. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Vectors per packed chunk.
CHUNK_ROWS = 2_048
_PACKED = "ids array<long>, counts array<int>, values array<long>, width int, places binary"


def _matrix(batch: pa.RecordBatch, column: int, scale: float, dimensions: int) -> np.ndarray:
    """The batch's vectors as integers, one row each."""
    lists = batch.column(column)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    scaled = np.floor(scale * flat)
    limit = isqrt(((1 << 63) - 1) // dimensions) // 2
    if len(scaled) and not np.abs(scaled).max() <= limit:
        raise ValueError(f"a component times {scale} is beyond {limit}: its squared distance has no 64-bit value")
    return scaled.astype(np.int64).reshape(len(lists), dimensions)


def pack(ids: pa.Array, codes: np.ndarray) -> pa.RecordBatch:
    """A chunk: per dimension its occurring values and every vector's place among them."""
    values, places = [], []
    for column in codes.T:
        v, p = np.unique(column, return_inverse=True)
        values.append(v)
        places.append(p)
    counts = np.array([len(v) for v in values], np.int32)
    width = 1 if counts.max(initial=0) <= 1 << 8 else 2 if counts.max() <= 1 << 16 else 4
    blob = np.array(places, f"<u{width}").tobytes()
    return pa.RecordBatch.from_pydict(
        {"ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int32())), "values": pa.array([np.concatenate(values)], pa.list_(pa.int64())), "width": pa.array([width], pa.int32()), "places": pa.array([blob], pa.binary())}
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """Inside a task: ids, occurring values per dimension, places (one row per dimension)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, counts, values = (batch.column(c)[i].values for c in range(3))
            counts, values = counts.to_numpy(), values.to_numpy()
            places = np.frombuffer(batch.column(4)[i].as_buffer(), f"<u{batch.column(3)[i].as_py()}").reshape(len(counts), -1)
            yield ids, np.split(values, np.cumsum(counts)[:-1]), places


def assign(values: list[np.ndarray], places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of every vector of a chunk, from one lookup table per dimension."""
    distance = np.zeros((places.shape[1], len(centroids)), np.int64)
    for v, p, c in zip(values, places, centroids.T, strict=True):
        squares = (v[:, None] - c) ** 2
        distance += squares[p]
    label = distance.argmin(axis=1)
    return label, distance[np.arange(len(label)), label]


def packed(df: DataFrame, scale: float, dimensions: int, id_column: str = "vec_id", vector: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The kept vectors in packed chunks."""

    def run(batches):
        for batch in batches:
            codes = _matrix(batch, 1, scale, dimensions)
            for a in range(0, len(codes), chunk_rows):
                yield pack(batch.column(0).slice(a, chunk_rows), codes[a : a + chunk_rows])

    return kept(df, dimensions, id_column, vector).mapInArrow(run, _PACKED)


def kept(df: DataFrame, dimensions: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.coalesce(F.size("v") == dimensions, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def first_centroids(df: DataFrame, clusters: int, seed: str, scale: float, dimensions: int, id_column: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The vectors whose ids have the smallest hashes, as integers."""
    hashed = kept(df, dimensions, id_column, vector).where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    best = hashed.orderBy("h", "v").limit(clusters).select("vec_id", "v").toArrow().combine_chunks()
    return np.concatenate([_matrix(b, 1, scale, dimensions) for b in best.to_batches()] + [np.zeros((0, dimensions), np.int64)])


def moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty cluster's floor of the mean, exactly."""
    clusters, dimensions = centroids.shape

    def run(batches):
        n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for _, values, places in _chunks(batches):
            label, _ = assign(values, places, centroids)
            n += np.bincount(label, minlength=clusters)
            for d, (v, p) in enumerate(zip(values, places, strict=True)):
                # A chunk's sums stay below 2^53: exact as doubles.
                sums[:, d] += np.bincount(label, weights=v[p], minlength=clusters).astype(np.int64)
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "s": pa.array([np.append(sums[k], n[k])], pa.list_(pa.int64()))})

    parts = chunks.mapInArrow(run, "k int, s array<long>").select("k", F.posexplode("s").alias("d", "s"))
    out, totals = centroids.copy(), {}
    for r in parts.groupBy("k", "d").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():
        totals[r.k, r.d] = int(r.s)
    for k in range(clusters):
        if (k, dimensions) in totals:
            out[k] = [totals[k, d] // totals[k, dimensions] for d in range(dimensions)]
    return out


def cluster(df: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3", scale: float = 1024, dimensions: int = 64, id_column: str = "vec_id", vector: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    centroids = first_centroids(df, clusters, seed, scale, dimensions, id_column, vector)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    chunks = keep(packed(df, scale, dimensions, id_column, vector, chunk_rows), "packed")
    for _ in range(rounds):
        last, centroids = centroids, moved(chunks, centroids)
        if (last == centroids).all():
            break

    def run(batches):
        for ids, values, places in _chunks(batches):
            label, distance = assign(values, places, centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return keep(chunks.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and the sha256 of its centroid."""
    by = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    if not by:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))

    def of(values):
        return F.array(*[F.lit(x) for x in values])[F.col("cluster")]

    return assigned.select("*", of([by.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(sum(by.values())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"))
