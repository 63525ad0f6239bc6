"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document if the document holds at least `threshold` (0.8) of the item's distinct five-word
shingles. Documents are long and items short, so items are indexed and documents search. Items are partitioned by their
number of shingles (powers of two). The MinHash sketch of an item is its k smallest shingle hashes, with
k = n - ceil(threshold n) + 1 for the n of the item; whatever the hash, a document that holds the threshold of an item
holds at least one of its k smallest, so the search loses nothing. In each partition a document that holds fewer
distinct shingles than the partition's least item needs skips it; the other hits are verified by exact containment of
the shingles' words.

The items are a stated query set against all rows: they are taken in blocks of bounded size, and each block is sent to
the executors and scanned against the documents once. Documents are not shuffled.

Words are `[^\\x20\\x09-\\x0D]+`, lower-cased A-Z. An item of fewer words is one shingle: it is found in a document that
is the same short word sequence. Null and empty items or documents match nothing. Equal items each match; repeated rows
each give their matches. Null ids are carried as null. Other columns are kept by `screen`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, each_text, shingle_hashes

#: Items per block; the block's texts and sketches are what an executor holds.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _grams(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    w = _WORD.findall(text.lower())  # bytes.lower() touches A-Z only
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


class ItemIndex:
    """Sketches of a block of items by size partition: sorted hashes, each with the items whose sketch has it."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, num: int, den: int):
        self.ids = [i for i, _ in items]
        self.grams = [_grams((t or "").encode(), size) for _, t in items]
        flat, offsets = byte_view(pa.array([t or "" for _, t in items], pa.large_string()))
        sketches, self.least = [], np.zeros(len(items), np.int64)
        partition: dict[int, int] = {}  # least number of found shingles that an item of the size partition needs
        sizes = []
        for h in shingle_hashes(flat, offsets, size):
            need = -(-num * len(h) // den)
            sizes.append(len(h).bit_length())
            partition[sizes[-1]] = min(need, partition.get(sizes[-1], need))
            sketches.append(h[: len(h) - need + 1])
        self.least = np.array([partition[s] for s in sizes], np.int64)
        keys = np.concatenate([*sketches, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], np.repeat(np.arange(len(items)), [len(s) for s in sketches])[order]

    def search(self, hashes: np.ndarray) -> list[int]:
        """Items whose sketch meets the document's distinct hashes."""
        if not len(self.keys) or not len(hashes):
            return []
        first = np.searchsorted(self.keys, hashes)
        first = first[self.keys[np.minimum(first, len(self.keys) - 1)] == hashes]
        if not len(first):
            return []
        last = np.searchsorted(self.keys, self.keys[first], "right")
        found = np.unique(np.concatenate([self.of[a:b] for a, b in zip(first, last, strict=True)]))
        return found[self.least[found] <= len(hashes)].tolist()


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_found", pa.int64())]))
_HIT_TYPE = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_found", T.LongType())]))


def _item_blocks(items: DataFrame, item_id: str, text: str):
    """The items in bounded blocks, one in the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += 4 * len(row.t or "") + 64
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(df: DataFrame, block: list, text: str, size: int, num: int, den: int, name: str) -> DataFrame:
    """Add to every row the block's items found in it."""
    sent = df.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        index = ItemIndex(sent.value, size, num, den)
        for batch, flat, offsets in each_text(batches, text):
            hits: list[list] = []
            for d, hashes in enumerate(shingle_hashes(flat, offsets, size)):
                hits.append([])
                candidates = index.search(hashes)
                if candidates:
                    have = _grams(flat[offsets[d] : offsets[d + 1]].tobytes(), size)
                    for i in candidates:
                        n, both = len(index.grams[i]), len(index.grams[i] & have)
                        if both * den >= num * n:
                            hits[-1].append({"item_id": index.ids[i], "n_item": n, "n_found": both})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, _HITS)], names=[*batch.schema.names, name])

    return df.mapInArrow(search, T.StructType([*df.schema, T.StructField(name, _HIT_TYPE)]))


def screen(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), name: str = "hits") -> DataFrame:
    """All rows of df with an array column `name` of the items found: item_id, n_item and n_found shingles."""
    num, den = threshold
    out = df.withColumn(name, F.array().cast(_HIT_TYPE))
    for block in _item_blocks(items, item_id, item_text):
        scanned = _scan(out, block, text, size, num, den, f"_{name}")
        out = scanned.withColumn(name, F.concat(name, F.col(f"_{name}"))).drop(f"_{name}")
    return out


def matches(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_item, n_found, containment."""
    hits = screen(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), items, **options)
    return hits.select("doc_id", F.inline("hits")).withColumn("containment", F.col("n_found") / F.col("n_item"))
