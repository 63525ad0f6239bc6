"""Helpers shared by the operators: shared storage, packed chunks of rows, words and shingles as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: Bytes of text that one numpy pass holds; eight-byte work arrays of this length fit the processor's cache.
SLICE_BYTES = 1 << 20
#: Bytes of text in one packed chunk.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the storage that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, kind: str = "kept") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case; nor with one more underscore."""
    taken = {c.lower() for c in df.columns}
    while {name.lower(), f"_{name.lower()}"} & taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """File system and path of a shared folder's URI (file, hdfs, s3, gs); for use inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:] if not uri.startswith("file://") else uri[7:]
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- texts as arrays

def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings with 64-bit offsets, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after the other, and the n + 1 offsets of the texts."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut texts into runs of at most `most` bytes, or one text where it is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


_rng = np.random.default_rng(20240501)
_FOLD = _rng.integers(0, 2**64, 256, np.uint64)  # a random value per byte; capitals get those of the small letters
_EXACT = _FOLD.copy()
_FOLD[65:91] = _FOLD[97:123]
_WORD = _rng.integers(0, 2**64, 8, np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n modulo 2^64, and their inverses."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Prefix polynomial hashes of a byte string: any substring's hash in one subtraction and one product."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        self.power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLD if fold_case else _EXACT)[data] * self.power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word `[^\\x20\\x09-\\x0D]+`, and the n + 1 offsets of the texts into them."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[flat]
    edge = np.empty(len(flat), bool)
    edge[0] = True
    edge[1:] = ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[first] = True
    starts = np.flatnonzero(inside & edge)
    edge[:-1] = ~inside[1:]
    edge[-1] = True
    edge[:-1][first[first > 0] - 1] = True
    stops = np.flatnonzero(inside & edge) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mix(Prefixes(flat, fold_case=True).of(starts, stops) + (stops - starts).astype(np.uint64))


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Per text its distinct shingles of `size` lower-cased words as sorted 64-bit hashes.

    A text with fewer words gives its whole word sequence as one shingle; one without words gives none.
    """
    starts, stops, at = words(flat, offsets)
    h = word_hashes(flat, starts, stops)
    n = len(h) - size + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for j in range(size):
            grams += h[j : j + n] * _WORD[j]
        grams = mix(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1])
            yield g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            yield mix((h[a:b] * _WORD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def each_text(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices: the rows, the texts' bytes and their offsets."""
    for batch in batches:
        flat, offsets = byte_view(text_column(batch, column))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def add_word_count(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Add the number of words of the whole text (0 for null)."""

    def count(batches):
        for batch, flat, offsets in each_text(batches, text):
            _, _, at = words(flat, offsets)
            yield with_column(batch, name, pa.array(np.diff(at).astype(np.int64)))

    return df.mapInArrow(count, df.select("*", F.lit(0).cast("long").alias(name)).schema)


# ---------------------------------------------------------------- packed chunks

class Chunks:
    """Rows packed into chunks of a few megabytes of text and kept in a table bucketed by chunk.

    Per-chunk answers of a later stage meet their rows in a join on `chunk` that moves only the answers.
    """

    def __init__(self, df: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.row = df.sparkSession, df.schema
        from pyspark import TaskContext

        def pack(batches):
            row_type, seq = None, 0
            held, size = [], 0
            base = TaskContext.get().partitionId() << 32

            def chunk():
                nonlocal held, size, seq
                rows = pa.concat_arrays(held)
                out = pa.RecordBatch.from_arrays([pa.array([base + seq]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["chunk", "rows"])
                held, size, seq = [], 0, seq + 1
                return out

            for batch in batches:
                rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
                row_type = rows.type
                lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths + 16)))
                a = 0
                while a < len(rows):
                    b = max(a + (size == 0), int(np.searchsorted(offsets, offsets[a] + chunk_bytes - size, "right")) - 1)
                    if b > a:
                        held.append(rows.slice(a, b - a))
                        size += int(offsets[b] - offsets[a])
                    if b < len(rows):
                        yield chunk()
                    a = b
            if held:
                yield chunk()

        from pyspark.sql import types as T

        schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(self.row))])
        self.buckets = partitions(self.spark)
        name = f"chunks_{uuid.uuid4().hex}"
        df.mapInArrow(pack, schema).write.bucketBy(self.buckets, "chunk").option("compression", "zstd").option("path", new_folder(self.spark, "chunks")).saveAsTable(name)
        self.table = self.spark.table(name)
        self.schema = self.table.schema
        self.count = self.table.count()

    def with_answers(self, answers: DataFrame) -> DataFrame:
        """The chunks with their answers (part, blob), if any, in a column `answers`."""
        a = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "blob")).alias("answers"))
        return self.table.join(a, "chunk", "left")


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, dict[int, bytes]]]:
    """Inside a task: chunk number, its rows, and the answers by part."""
    for batch in batches:
        rows, ids = batch.column(1), batch.column(0).to_pylist()
        has = batch.num_columns > 2
        for i, c in enumerate(ids):
            found = {x["part"]: x["blob"] for x in batch.column(2)[i].as_py() or ()} if has else {}
            yield c, rows[i].values, found


def parts_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Bounds of each part in ascending keys of so many bits."""
    bounds = np.array([-(-(i << bits) // parts) for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges: (node, label), label the smallest node of the component.

    Labels pass to neighbours and are then shortened by pointer jumping, so rounds grow with the logarithm of the
    diameter; each round is kept in the shared folder. Only one count per round reaches the driver.
    """
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        new = keep(step.join(up, "next").select("node", F.least("next", "above").alias("label"), (F.least("next", "above") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels
