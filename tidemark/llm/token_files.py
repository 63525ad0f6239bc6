"""Token-id files with Elias-Fano encoded document boundaries.

A shard is two files. `<n>.ids` holds the concatenated ids of its documents as little-endian unsigned integers of two
bytes (four if the vocabulary needs it). `<n>.ef` holds the documents' cumulative lengths in Elias-Fano form: the low l
bits of each value packed side by side, the high bits as a unary bit vector, and one sample per SAMPLE set bits. With n
boundaries up to u this takes n (2 + log2(u / n)) bits, near the minimum; select(i) finds the i-th set bit from the
nearest sample, so offsets need no table of 64-bit numbers. Boundaries are local to a shard; a shard's first global
offset is the sum of the totals in the manifest before it.

Documents are dealt by range of id (nulls first), so shards in order of number hold ascending ids. A shard streams its
ids to its file; in memory are one Arrow batch and the boundaries. Each attempt of a task writes files under its own
name, and the manifest row it returns names them: files of lost or repeated attempts are never read.

Null and empty texts have only the end id. Repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, file_system, keep, new_folder, partitions, slices, text_column
from .tokenize import default_vocabulary, word_encoder

END_ID = 1
SAMPLE = 256
MAGIC = b"EFB1"
SLICE = 4 << 20
_HEAD = struct.Struct("<4sQQB")  # magic, number of boundaries, last boundary, low bits


class EliasFano:
    """A non-decreasing sequence of n integers up to u."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high, self.samples = n, u, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        bits = np.zeros((n, low_bits), np.uint8)
        for j in range(low_bits):
            bits[:, j] = (v >> np.uint64(j)) & np.uint64(1)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, u, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype("<u4" if len(unary) < 2**32 else "<u8"))

    def select(self, first: int, stop: int) -> np.ndarray:
        """Values first..stop - 1: walks the unary bits from the sample before `first`."""
        if first >= stop:
            return np.zeros(0, np.uint64)
        s = first // SAMPLE
        begin = int(self.samples[s])
        end_sample = (stop - 1) // SAMPLE + 1
        end = int(self.samples[end_sample]) if end_sample < len(self.samples) else len(self.high) * 8
        byte = begin // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : -(-end // 8)], bitorder="little")) + byte * 8
        ones = ones[ones >= begin][first - s * SAMPLE : stop - s * SAMPLE]
        high = (ones - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        a, b = first * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize
        return _HEAD.pack(MAGIC, self.n, self.u, self.low_bits) + struct.pack("<QQB", len(self.low), len(self.high), wide) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        magic, n, u, low_bits = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a boundary file")
        n_low, n_high, wide = struct.unpack_from("<QQB", raw, _HEAD.size)
        at = _HEAD.size + 17
        data = np.frombuffer(raw, np.uint8)
        return cls(n, u, low_bits, data[at : at + n_low], data[at + n_low : at + n_low + n_high], data[at + n_low + n_high :].view(f"<u{wide}"))


_MANIFEST = "shard int, ids_path string, ef_path string, width int, docs long, tokens long, doc_ids array<long>"


def write_shards(df: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the shards; the manifest (kept) has a row per shard."""
    vocabulary = vocabulary or default_vocabulary()
    spark = df.sparkSession

    def write(batches):
        from pyspark import TaskContext

        encoder = word_encoder(vocabulary)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        lengths, doc_ids = [], []
        with fs.open_output_stream(f"{name}.ids") as out:
            for batch in batches:
                texts = text_column(batch, "text")
                doc_ids.append(batch.column(0).cast(pa.int64()))
                _, offsets = byte_view(texts)
                for a, b in slices(offsets, SLICE):
                    ids, at = encoder.encode(texts.slice(a, b - a))
                    n = np.diff(at) + 1
                    ends = np.cumsum(n) - 1
                    full = np.full(len(ids) + b - a, end_id, f"<u{width}")
                    body = np.ones(len(full), bool)
                    body[ends] = False
                    full[body] = ids
                    out.write(full.tobytes())
                    lengths.append(n)
        if not doc_ids:
            fs.delete_file(f"{name}.ids")
            return
        bounds = np.cumsum(np.concatenate(lengths))
        with fs.open_output_stream(f"{name}.ef") as out:
            out.write(EliasFano.build(bounds).to_bytes())
        ids = pa.chunked_array(doc_ids).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([f"{name}.ids"]), pa.array([f"{name}.ef"]), pa.array([width], pa.int32()), pa.array([len(bounds)]), pa.array([int(bounds[-1])]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
            names=["shard", "ids_path", "ef_path", "width", "docs", "tokens", "doc_ids"],
        )

    n = shards or max(partitions(spark), 1)
    dealt = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return keep(dealt.mapInArrow(write, _MANIFEST), "manifest")


def read_shards(manifest: DataFrame, folder: str, read_tokens: int = 1 << 21) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""
    totals = {r["shard"]: r["tokens"] for r in manifest.select("shard", "tokens").collect()}  # a number per shard
    first, at = {}, 0
    for shard in sorted(totals):
        first[shard], at = at, at + totals[shard]

    def read(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for i, row in enumerate(batch.select(["shard", "ids_path", "ef_path", "width", "docs"]).to_pylist()):
                with fs.open_input_stream(row["ef_path"]) as f:
                    ef = EliasFano.from_bytes(f.read())
                ids, n, width = batch.column(batch.schema.get_field_index("doc_ids"))[i].values, row["docs"], row["width"]
                with fs.open_input_file(row["ids_path"]) as f:
                    a = 0
                    while a < n:
                        # Documents up to about read_tokens ids are read at once.
                        b = min(n, a + SAMPLE)
                        bounds = np.concatenate((ef.select(a - 1, a) if a else np.zeros(1, np.uint64), ef.select(a, b))).astype(np.int64)
                        b = a + max(1, int(np.searchsorted(bounds, bounds[0] + read_tokens, "right")) - 1)
                        bounds = bounds[: b - a + 1]
                        f.seek(int(bounds[0]) * width)
                        got = np.frombuffer(f.read(int(bounds[-1] - bounds[0]) * width), f"<u{width}").astype("<u4")
                        cut = bounds - bounds[0]
                        sums = [zlib.crc32(got[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(bounds[:-1] + first[row["shard"]]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        a = b

    spread = manifest.repartition(max(1, min(len(totals), 10_000)), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files and return what they hold per document."""
    folder = folder or new_folder(df.sparkSession, "tokens")
    return read_shards(write_shards(df, folder, **options), folder)
