"""Ranked lexical search with per-term geometric blocks.

Items are a stated query set against all rows. They go in blocks of bounded size (items, bytes); for each block of items the
documents are read once and become a forward index of the items' terms: packed chunks of documents, with every document's
number of terms and its counts of these terms, written to the shared folder. Numbers of documents and terms, and each
term's document frequency, are counted over all documents.

A task then indexes chunk by chunk. The posting list of a term is cut into geometric blocks: documents of the list are
clustered by similarity, each to the nearest of evenly chosen pivots of the list (random projections of the documents'
weighted terms), and each block stores its summary, the coordinatewise maximum of its documents' term values. An item's
product with a summary bounds the score of every document of the block, in exact integers; a block is skipped only if that
bound is below the item's threshold, the score of the k-th document that the task has found for it so far. Lists whose
largest values together stay below the threshold are not opened, so their blocks are never built. Documents of the blocks
that are left are scored exactly. While an item has found fewer than k documents, no bound can fail and the documents of all
its lists are scored. Each task returns its k best per item, and the best of all tasks are merged: a document that a
threshold drops has k better ones in its own task. Tasks keep no state between each other and may be run again.

Terms are the maximal runs of `[0-9A-Za-z]` and of characters beyond U+007F, only A-Z lower-cased. Of N documents with a
term, L terms in all, n terms in the document: weight w = floor(1000 ln((2N + 2) / (2df + 1))), length norm
m = 50 + (50 n N) div L, and the score is the sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

Null and empty texts, and texts without a term, have no score and do not count in N; items without a term, or none of whose
terms occurs, have no rows. Only scores above 0 are ranked. Ties go to the smaller doc_id (null before all); rows that repeat
a doc_id are documents of their own. Items equal in id and text count once; different texts under one id are ranked each by
itself. A document is one numpy pass however long (some 60 bytes per byte of text). Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import each_text, keep

#: Items and bytes of text per block of items.
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 4 << 20
#: Documents and counts per packed chunk; bytes of a chunk's matrix of term values (a wider one is searched in parts).
CHUNK_DOCS = 2_048
CHUNK_COUNTS = 1 << 20
MATRIX_BYTES = 64 << 20
#: Documents per geometric block, on average, and dimensions of the projections that place them.
BLOCK_DOCS = 32
PROJECTIONS = 24

_INSIDE = np.zeros(256, bool)
_INSIDE[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_PACKED = "doc_ids array<long>, norms array<long>, counts array<int>, terms binary, tf binary, docs long, total long"


def item_terms(text: str | None) -> list[bytes]:
    """Distinct terms of an item, ascending."""
    return sorted(set(_TERM.findall((text or "").encode(errors="replace").lower())))  # bytes.lower() touches A-Z only


class Items:
    """A block of items: distinct terms, and each item's terms by their place."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found = [(i, t) for i, x in rows if (t := item_terms(x))]
        self.ids = [i for i, _ in found]
        self.terms = sorted({t for _, ts in found for t in ts})
        place = {t: p for p, t in enumerate(self.terms)}
        self.of = [np.array([place[t] for t in ts], np.int64) for _, ts in found]


def runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every term, and the n + 1 offsets of the texts into them."""
    inside = _INSIDE[flat]
    first = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    before, after = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first] = False
    after[first[1:] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def count_terms(flat: np.ndarray, offsets: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its number of terms; and (text, place of the term, count) of every wanted term in it, in this order."""
    starts, stops, at = runs(flat, offsets)
    n = np.diff(at)
    if not len(starts) or not len(terms):
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    # Every other slice between these cuts is a term.
    cuts = np.column_stack((starts, stops)).reshape(-1).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(_FOLD[flat])])
    place = pc.fill_null(pc.index_in(pieces, value_set=terms), -1).to_numpy()[::2]
    hit = np.flatnonzero(place >= 0)
    text = np.searchsorted(at, hit, "right") - 1
    key, count = np.unique(text * len(terms) + place[hit], return_counts=True)
    return n, key // len(terms), key % len(terms), count


def forward_index(df: DataFrame, terms: list[bytes], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed chunks of the documents that hold one of the terms; `docs` and `total` count all documents with terms."""
    wanted_terms = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = pa.array(wanted_terms.value, pa.large_binary())
        held: list[list[np.ndarray]] = []
        size, docs, total = 0, 0, 0
        ids: list[pa.Array] = []

        def chunk():
            nonlocal held, ids, size, docs, total
            n, counts, place, tf = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * 4
            doc_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    "norms": pa.array([n.astype(np.int64)], pa.list_(pa.int64())),
                    "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    "terms": pa.array([place.astype("<i4").tobytes()], pa.binary()),
                    "tf": pa.array([tf.astype("<i4").tobytes()], pa.binary()),
                    "docs": pa.array([docs], pa.int64()),
                    "total": pa.array([total], pa.int64()),
                }
            )
            held, ids, size, docs, total = [], [], 0, 0, 0
            return out

        rows = 0
        for batch, flat, offsets in each_text(batches, "text"):
            n, doc, place, tf = count_terms(flat, offsets, wanted)
            docs += int((n > 0).sum())
            total += int(n.sum())
            some, counts = np.unique(doc, return_counts=True)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            a = 0
            while a < len(some):
                b = min(len(some), a + CHUNK_DOCS - rows, max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK_COUNTS - size, "right")) - 1))
                ids.append(batch.column(0).cast(pa.int64()).take(pa.array(some[a:b])))
                held.append([n[some[a:b]], counts[a:b], place[cuts[a] : cuts[b]], tf[cuts[a] : cuts[b]]])
                size, rows = size + int(cuts[b] - cuts[a]), rows + b - a
                if rows >= CHUNK_DOCS or size >= CHUNK_COUNTS:
                    yield chunk()
                    rows = 0
                a = b
        if held or docs:
            yield chunk()

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PACKED)


def document_frequency(index: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; one partial count per task and term."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), "<i4"), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(total[some])})

    out = np.zeros(terms, np.int64)
    counted = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def term_values(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) for documents of n terms; exact beyond 64 bits too."""
    n = n.astype(np.int64)
    top = 50 * int(n.max(initial=0)) * documents
    part = (50 * n * documents) // total if top < 1 << 63 else np.array([50 * x * documents // total for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 20 * (50 + part))


class ChunkIndex:
    """Posting lists of some documents, their geometric blocks and summaries, built as they are opened."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int, weight: np.ndarray, block_docs: int = BLOCK_DOCS):
        self.present, column = np.unique(term, return_inverse=True)
        self.weight, self.docs, self.block_docs = weight[self.present], docs, block_docs
        self.value = np.zeros((docs, len(self.present)), np.int32)
        self.value[doc, column] = value
        order = np.argsort(column, kind="stable")
        self.posting, self.cuts = doc[order], np.searchsorted(column[order], np.arange(len(self.present) + 1))
        self.most = np.maximum.reduceat(value[order], self.cuts[:-1]).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        self._points: np.ndarray | None = None

    def points(self) -> np.ndarray:
        """The documents' directions: random projections of their weighted terms."""
        if self._points is None:
            lines = np.random.default_rng(17).standard_normal((len(self.present), PROJECTIONS)).astype(np.float32) * self.weight[:, None].astype(np.float32)
            at = np.concatenate([self.value[a : a + 256].astype(np.float32) @ lines for a in range(0, self.docs, 256)])
            self._points = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-30)
        return self._points

    def blocks(self, column: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The term's documents block by block, the first place of each block, and the summaries' wanted columns."""
        docs = self.posting[self.cuts[column] : self.cuts[column + 1]]
        first = np.zeros(1, np.int64)
        if len(docs) > self.block_docs:
            at = self.points()[docs]
            near = (at @ at[:: self.block_docs].T).argmax(axis=1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
        if len(wanted) * 3 < len(self.present):
            rows = self.value[np.ix_(docs, wanted)]
            return docs, first, np.maximum.reduceat(rows, first, axis=0)
        return docs, first, np.maximum.reduceat(self.value[docs], first, axis=0)[:, wanted]

    def search(self, items: list[np.ndarray], threshold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per item the documents that may reach its threshold (0: any), and their exact scores."""
        columns = []
        opened: dict[int, list[int]] = {}
        pick = [np.zeros(0, bool)] * len(items)
        for q, terms in enumerate(items):
            c = np.searchsorted(self.present, terms)
            c = c[(c < len(self.present)) & (self.present[np.minimum(c, len(self.present) - 1)] == terms)] if len(self.present) else c[:0]
            c = c[self.weight[c] > 0]
            columns.append(c)
            if not len(c):
                continue
            if threshold[q] <= 0:
                continue
            # Lists that stay below the threshold all together need not be opened.
            least = np.argsort(self.weight[c] * self.most[c], kind="stable")
            low = np.cumsum((self.weight[c] * self.most[c])[least]) < threshold[q]
            pick[q] = np.zeros(self.docs, bool)
            for x in c[least[~low]].tolist():
                opened.setdefault(x, []).append(q)
        for column, asked in opened.items():
            wanted = np.unique(np.concatenate([columns[q] for q in asked]))
            docs, first, summary = self.blocks(column, wanted)
            ends = np.append(first[1:], len(docs))
            for q in asked:
                c = columns[q]
                bound = summary[:, np.searchsorted(wanted, c)].astype(np.int64) @ self.weight[c]
                for b in np.flatnonzero(bound >= threshold[q]).tolist():
                    pick[q][docs[first[b] : ends[b]]] = True
        for q, c in enumerate(columns):
            if len(c):
                docs = np.flatnonzero(pick[q]) if len(pick[q]) else np.unique(np.concatenate([self.posting[self.cuts[x] : self.cuts[x + 1]] for x in c.tolist()]))
                yield q, docs, self.value[np.ix_(docs, c)].astype(np.int64) @ self.weight[c]


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The items in bounded blocks, one in the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        block.append((row.i, row.t))
        size += 4 * len(row.t or "") + 64
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def best(index: DataFrame, items: Items, k: int, documents: int, total: int, weight: np.ndarray, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per task and item the k best documents: no (of the item), item_id, doc_id, score."""
    sent = index.sparkSession.sparkContext.broadcast((items.ids, items.of, weight))

    def run(batches):
        item_ids, of, w = sent.value
        found_id = [np.zeros(0, np.int64)] * len(of)
        found = [np.zeros(0, np.int64)] * len(of)
        threshold = np.zeros(len(of), np.int64)
        null = np.iinfo(np.int64).min  # a null id comes before all
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                ids = np.asarray(pc.fill_null(ids, null).to_numpy(zero_copy_only=False), np.int64)
                n, counts = (np.asarray(batch.column(c)[i].values.to_numpy(), np.int64) for c in (1, 2))
                term, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4") for c in (3, 4))
                value = term_values(tf, np.repeat(n, counts), documents, total)
                cuts = np.concatenate(([0], np.cumsum(counts)))
                step = max(1, MATRIX_BYTES // (4 * max(1, min(len(w), len(term)))))
                for a in range(0, len(ids), step):
                    b = min(len(ids), a + step)
                    part = slice(cuts[a], cuts[b])
                    chunk = ChunkIndex(np.repeat(np.arange(b - a), counts[a:b]), term[part], value[part], b - a, w, block_docs)
                    for q, docs, score in chunk.search(of, threshold):
                        good = score >= max(1, threshold[q])
                        x, s = np.concatenate((found_id[q], ids[a:b][docs[good]])), np.concatenate((found[q], score[good]))
                        order = np.lexsort((x, -s))[:k]
                        found_id[q], found[q] = x[order], s[order]
                        if len(order) == k:
                            threshold[q] = s[order[-1]]
        no = np.repeat(np.arange(len(of)), [len(x) for x in found])
        x = np.concatenate([*found_id, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_pydict(
            {"no": pa.array(no, pa.int32()), "item_id": pa.array([item_ids[q] for q in no.tolist()], pa.int64()), "doc_id": pa.array(x, mask=x == null), "score": pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))}
        )

    return index.select("doc_ids", "norms", "counts", "terms", "tf").mapInArrow(run, "no int, item_id long, doc_id long, score long")


def search(df: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    out = []
    for rows in _item_blocks(items, item_id, item_text):
        block = Items(rows)
        if not block.terms:
            continue
        index = keep(forward_index(df, block.terms, id_column, text), "terms")
        documents, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        if not documents:
            continue
        weight = weights(document_frequency(index, len(block.terms)), documents)
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = best(index, block, k, documents, total, weight, block_docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(keep(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    if not out:
        return df.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionAll(x)
    return whole
