"""N-gram Jaccard join by signature trees.

1. Documents are packed into chunks; each chunk tells every shingle's home partition once which shingles it holds, and
   learns from it in how many sets they occur. This is one shuffle of five bytes per distinct shingle and chunk.
2. A set's shingles are ordered rarest first. Two sets with Jaccard similarity >= t share one of their first
   n - ceil(t n) + 1 shingles, in any order that is the same for all sets, so a set whose first shingles occur nowhere
   else has no link and leaves. The counts only choose the order; colliding keys cannot lose a link.
3. Sets that share such a shingle form candidate clusters (connected components over one edge per set and shingle).
4. Inside a cluster a signature tree holds the sets in blocks of close size; a node has the OR of its sets' token
   bitmaps, its size range and the fewest bits of a set. A traversal of the tree against itself skips node pairs whose
   largest possible overlap is below what the threshold asks for, and pairs of sets that are already connected; the
   rest is compared exactly. A cluster above `block_bytes` is cut into blocks: every block meets the cluster's hub first,
   and sets linked to the hub are connected. Only the loose sets that are left still have to meet all others, in pairs
   of blocks with at least one block of loose sets, so a large group of near copies costs its size and no task holds
   more than two blocks.

Equal sets (copies) are one member from step 1 on, so a group of copies of any size costs one member per chunk.

Nulls and empty texts have no shingles: n_shingles 0, component_id their own doc_id. Repeated rows get one result row
each. A null doc_id is never smallest; a class of null ids alone has a null component_id. Other columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SLICE_BYTES, Chunks, byte_view, chunk_rows, components, keep, mix, partitions, parts_of, shingle_hashes, slices, text_column

KEY_BITS = 39
BITMAP_BITS = 4096
LEAF = 16
BLOCK_BYTES = 4 << 20


def _needed(a, b, num: int, den: int):
    """Smallest overlap of sets of a and b shingles with overlap / union >= num / den."""
    return -(-num * (a + b) // (num + den))


def _sets(rows: pa.StructArray, text: str, size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    column = text_column(pa.RecordBatch.from_arrays([rows.field(text)], names=[text]), text)
    flat, offsets = byte_view(column)
    for a, b in slices(offsets, SLICE_BYTES):
        out += shingle_hashes(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
    return out


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set."""
    return np.array([mix(np.array([s.sum(dtype=np.uint64) ^ mix(np.bitwise_xor.reduce(s)[None])[0]], np.uint64) + np.uint64(len(s)))[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct shingle keys in order, and whether more than one set has them."""
    every = np.sort(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - KEY_BITS))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(np.append(first, len(every))) > 1


def _distinct(sets: list[np.ndarray], names: np.ndarray) -> list[int]:
    return np.unique(names, return_index=True)[1].tolist() if len(sets) else []


def _home_counts(chunks: Chunks, text: str, size: int) -> DataFrame:
    """Per chunk and part the class of its shingles: 0 for one set only, else growing with the number of sets."""
    parts = max(partitions(chunks.spark), chunks.count // 8)

    def send(batches):
        for c, rows, _ in chunk_rows(batches):
            sets = _sets(rows, text, size)
            names = _set_keys(sets)
            keys, many = _keys([sets[i] for i in _distinct(sets, names)])
            at = parts_of(keys, parts, KEY_BITS)
            blob = (keys << np.uint64(1) | many.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), c)), pa.array([blob[at[p] : at[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "chunk", "blob"])

    def answer(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        n = [len(b) // 5 for b in blobs]
        raw = np.zeros((sum(n), 8), np.uint8)
        raw[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        keys = raw.view("<u8").ravel()
        many = (keys & np.uint64(1)).astype(np.int64)
        keys >>= np.uint64(1)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) > 0)))
        seen = np.add.reduceat(1 + many[order], first)
        kind = np.zeros(len(keys), np.uint8)
        kind[order] = np.repeat(np.minimum(255, np.ceil(4 * np.log2(seen))).astype(np.uint8), np.diff(np.append(first, len(keys))))
        cut = np.concatenate(([0], np.cumsum(n)))
        return pa.table({"part": group.column("part"), "chunk": group.column("chunk"), "blob": pa.array([kind[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    schema = "part int, chunk long, blob binary"
    return chunks.table.mapInArrow(send, schema).groupBy("part").applyInArrow(answer, schema)


def _survivors(chunks: Chunks, answers: DataFrame, id_column: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """A row per document (chunk, place, doc_id, n, name); on one row per chunk and set that may have links also its rare shingles and the set."""

    def select(batches):
        for c, rows, found in chunk_rows(batches):
            sets = _sets(rows, text, size)
            names = _set_keys(sets)
            distinct = _distinct(sets, names)
            keys, _ = _keys([sets[i] for i in distinct])
            kind = np.frombuffer(b"".join(found[p] for p in sorted(found)), np.uint8)
            if len(kind) != len(keys):
                raise ValueError(f"{len(kind)} answers for {len(keys)} shingles")
            rare, whole = [None] * len(sets), [None] * len(sets)
            for i in distinct:
                s = sets[i]
                if not len(s):
                    continue
                k = kind[np.searchsorted(keys, s >> np.uint64(64 - KEY_BITS))]
                head = np.argsort(k, kind="stable")[: len(s) - -(-num * len(s) // den) + 1]
                if shared := s[head[k[head] > 0]].view(np.int64).tolist():
                    rare[i], whole[i] = shared, s.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sets), c)), pa.array(np.arange(len(sets), dtype=np.int32)), rows.field(id_column).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names), pa.array(rare, pa.list_(pa.int64())), pa.array(whole, pa.binary())],
                names=["chunk", "place", "doc_id", "n", "name", "rare", "whole"],
            )

    return chunks.with_answers(answers).mapInArrow(select, "chunk long, place int, doc_id long, n long, name long, rare array<long>, whole binary")


class SignatureTree:
    """Sets in order of size; leaves of up to LEAF sets, each higher node over two. Bitmaps are packed bytes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        marks = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(sets):
            marks[i, (mix(s) % np.uint64(bits)).astype(np.int64)] = True
        self.maps = np.packbits(marks, axis=1).view(np.uint64)
        self.few = marks.sum(axis=1)
        self.sizes = np.array([len(s) for s in sets])
        cuts = list(range(0, len(sets), LEAF))
        level = [(a, min(a + LEAF, len(sets)), None) for a in cuts]
        while len(level) > 1:
            level = [(kids[0][0], kids[-1][1], kids) for kids in (level[i : i + 2] for i in range(0, len(level), 2))]
        self.root = level[0]
        self._summaries: dict[tuple[int, int], tuple] = {}

    def summary(self, a: int, b: int) -> tuple[np.ndarray, int, int, int]:
        """OR of the bitmaps, least and greatest size, fewest bits of a set."""
        if (a, b) not in self._summaries:
            self._summaries[a, b] = (np.bitwise_or.reduce(self.maps[a:b], axis=0), int(self.sizes[a]), int(self.sizes[b - 1]), int(self.few[a:b].min()))
        return self._summaries[a, b]


def _self_join(sets: list[np.ndarray], num: int, den: int, on_pair, bits: int, left: int | None = None) -> None:
    """Call on_pair(i, j) -> bool for pairs that the tree can't rule out; with `left`, only for i < left <= j pairs.

    on_pair is asked once per unordered pair of indices into `sets`.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    tree = SignatureTree([sets[i] for i in order], bits)
    ids = np.array(order)
    stack = [(tree.root, tree.root)]
    while stack:
        x, y = stack.pop()
        if x[:2] != y[:2]:
            (map_x, low_x, high_x, few_x), (map_y, low_y, high_y, few_y) = tree.summary(*x[:2]), tree.summary(*y[:2])
            if high_x * den < low_y * num or high_y * den < low_x * num:
                continue
            both = int(np.bitwise_count(map_x & map_y).sum())
            most = min(high_x - max(0, few_x - both), high_y - max(0, few_y - both))
            if most < _needed(low_x, low_y, num, den):
                continue
        if x[2] is None and y[2] is None:
            a, b = np.arange(*x[:2]), np.arange(*y[:2])
            p, q = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
            ok = p < q
            if left is not None:
                ok &= (ids[p] < left) != (ids[q] < left)
            p, q = p[ok], q[ok]
            n, m = tree.sizes[p], tree.sizes[q]
            need = _needed(n, m, num, den)
            both = np.bitwise_count(tree.maps[p] & tree.maps[q]).sum(axis=1).astype(np.int64)
            ok = np.minimum(n - (tree.few[p] - both), m - (tree.few[q] - both)) >= need
            for i, j in zip(ids[p[ok]].tolist(), ids[q[ok]].tolist(), strict=True):
                on_pair(i, j)
        elif x[:2] == y[:2]:
            kids = x[2]
            stack += [(u, v) for i, u in enumerate(kids) for v in kids[i:]]
        else:
            one, other = (x, y) if y[2] is None or (x[2] is not None and x[1] - x[0] >= y[1] - y[0]) else (y, x)
            stack += [(k, other) if k[0] <= other[0] else (other, k) for k in one[2]]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least num / den."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    overlap = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return overlap * den >= num * (len(a) + len(b) - overlap)


def join_sets(names: np.ndarray, sets: list[np.ndarray], num: int, den: int, left: int | None = None, all_pairs: bool = False, joined: int = 0) -> list[tuple[int, int]]:
    """Links between sets by a signature tree: a spanning forest of the link graph, or every link.

    With `left`, only links between the first `left` sets and the others; the first `joined` sets are known to be connected.
    """
    parent = [0] * joined + list(range(joined, len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def on_pair(i: int, j: int) -> None:
        x, y = root(i), root(j)
        if (all_pairs or x != y) and linked(sets[i], sets[j], num, den):
            parent[max(x, y)] = min(x, y)
            out.append((int(names[i]), int(names[j])))

    if len(sets) == 2 and left in (None, 1):
        on_pair(0, 1)
    elif len(sets) > 2:
        _self_join(sets, num, den, on_pair, BITMAP_BITS, left)
    return out


def set_links(rows: DataFrame, num: int, den: int, all_pairs: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between names of different sets, from kept rows (name, n, rare, whole)."""
    spark = rows.sparkSession
    may = rows.where("rare is not null")
    pairs = may.select("name", F.explode("rare").alias("token"))
    hubs = pairs.groupBy("token").agg(F.min("name").alias("hub"), F.max("name").alias("last")).where("hub <> last").select("token", "hub")
    edges = pairs.join(hubs, "token").where("name <> hub").select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(edges).withColumnsRenamed({"node": "name", "label": "cluster"})
    members = keep(may.dropDuplicates(["name"]).select("name", "whole").join(clusters, "name"), "members")
    weight = F.length("whole") + BITMAP_BITS // 4
    sizes = keep(members.groupBy("cluster").agg(F.ceil(F.sum(weight) / block_bytes).cast("int").alias("blocks"), F.min("name").alias("hub")), "clusters")
    m = members.join(sizes, "cluster")
    parts, zero = partitions(spark), F.lit(0)
    columns = ["name", "whole", "cluster", "kind", "part", "i", "j", "deal"]

    def dealt(df: DataFrame, kind: int, part, i, j, deal) -> DataFrame:
        return df.withColumns({"kind": F.lit(kind), "part": part, "i": i, "j": j}).withColumn("deal", deal).select(columns)

    pairs_of = F.xxhash64("cluster", "kind", "i", "j")
    work = dealt(m.where("blocks = 1"), 0, zero, zero, zero, F.pmod(F.xxhash64("cluster"), F.lit(parts * 4)))
    links = None
    if sizes.where("blocks > 1").limit(1).count():
        # A third of all sets may be one cluster.
        large = m.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
        loose = large
        if not all_pairs:
            hubs = large.where("name = hub").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
            met = large.where("name <> hub").unionAll(hubs.select(large.columns)).select("cluster", "block", "name", "hub", "whole")

            def meet(group: pa.Table) -> pa.Table:
                names, hub = group.column("name").to_numpy(), group.column("hub").to_numpy()
                sets = [np.frombuffer(x.as_py(), "<u8") for x in group.column("whole")]
                centre = sets[int(np.flatnonzero(names == hub)[0])]
                return pa.table({"name": group.column("name"), "hub": group.column("hub"), "near": pa.array([linked(x, centre, num, den) for x in sets])})

            near = keep(met.groupBy("cluster", "block").applyInArrow(meet, "name long, hub long, near boolean").where("near").distinct(), "near")
            links = near.where("name <> hub").select(F.col("hub").alias("a"), F.col("name").alias("b"))
            close, loose = large.join(near.select("name"), "name", "left_semi"), large.join(near.select("name"), "name", "left_anti")
        loose_sizes = keep(loose.groupBy("cluster").agg(F.ceil(F.sum(weight) / block_bytes).cast("int").alias("loose_blocks")), "loose")
        loose = loose.join(loose_sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("name"), "loose_blocks").cast("int"))
        own = loose.withColumn("other", F.explode(F.sequence(zero, F.col("loose_blocks") - 1)))
        work = work.unionAll(dealt(own, 1, F.col("own"), F.least("own", "other"), F.greatest("own", "other"), pairs_of))
        if not all_pairs:
            to_loose = close.join(loose_sizes, "cluster").withColumn("other", F.explode(F.sequence(zero, F.col("loose_blocks") - 1)))
            to_close = loose.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
            work = work.unionAll(dealt(to_loose, 2, zero, F.col("block"), F.col("other"), pairs_of)).unionAll(dealt(to_close, 2, F.lit(1), F.col("other"), F.col("own"), pairs_of))

    def join(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("name", "cluster", "kind", "part", "i", "j")}
        order = np.lexsort((cols["name"], cols["part"], cols["j"], cols["i"], cols["kind"], cols["cluster"]))
        key = np.stack([cols[c][order] for c in ("cluster", "kind", "i", "j")])
        cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]))
        blobs, out = group.column("whole"), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = order[a:b]
            sets = [np.frombuffer(blobs[int(i)].as_py(), "<u8") for i in mine]
            kind, i, j = key[1:, a].tolist()
            left = None if kind == 0 or kind == 1 and i == j else int(np.searchsorted(cols["part"][mine], j if kind == 1 else 1))
            out += join_sets(cols["name"][mine], sets, num, den, left, all_pairs, left if kind == 2 else 0)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    found = work.groupBy("deal").applyInArrow(join, "a long, b long")
    return found if links is None else found.unionAll(links)


def _join(chunks: Chunks, id_column: str, text: str, size: int, threshold: tuple[int, int], all_pairs: bool, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    num, den = threshold
    rows = keep(_survivors(chunks, _home_counts(chunks, text, size), id_column, text, size, num, den), "sets")
    return rows.select("chunk", "place", "doc_id", F.col("n").alias("n_shingles"), "name"), set_links(rows, num, den, all_pairs, block_bytes)


def ngram_join(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), all_pairs: bool = False, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, name) of every row and the links (a, b) between names of different sets.

    threshold is the least Jaccard similarity as a fraction. Without all_pairs the links are a spanning forest.
    """
    chunks = Chunks(df.select(id_column, text), text, chunk_bytes)
    members, links = _join(chunks, id_column, text, size, threshold, all_pairs, block_bytes)
    return members.select("doc_id", "n_shingles", "name"), links


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with shingles and the label of their class; a name without a link is its own class."""
    labels = components(links).withColumnsRenamed({"node": "name"})
    return members.where("n_shingles > 0").join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))


def classes(df: DataFrame, **options) -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id reachable by links (itself included)."""
    members, links = ngram_join(df, **options)
    known = _labelled(members, links).select("doc_id", "n_shingles", "label")
    # Kept, so that the join deals rows anew and a hot class can be split.
    smallest = keep(known.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")
    linked_rows = known.join(smallest, "label").select("doc_id", "n_shingles", "component_id")
    return linked_rows.unionAll(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def distinct_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of df, all columns, without near-duplicates: the smallest id of each class stays (one row of it), and all
    rows without shingles. Rows come back from the chunks, so texts don't move again."""
    chunks = Chunks(df, text, chunk_bytes)
    members, links = _join(chunks, id_column, text, size, threshold, False, block_bytes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "chunk", "place")).alias("first")
    stay = _labelled(members, links).groupBy("label").agg(first).select("first.chunk", "first.place")
    stay = stay.unionAll(members.where("n_shingles = 0").select("chunk", "place"))
    places = stay.groupBy("chunk").agg(F.array_sort(F.collect_list("place")).alias("places"))
    rows = chunks.table.join(places, "chunk").select(F.explode(F.transform("places", lambda p: F.element_at("rows", p + 1))).alias("row"))
    return rows.select("row.*")
