"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pre-tokeniser is an automaton over classes of code points, and no regular expression runs over the texts. A text's
code points become classes in one gather; an apostrophe's and a white space's class also tells what follows it, which is
all the lookahead that the splitting rule (`public_tokenizers.PATTERN`) has. Each class is a transition function on the
automaton's states. Functions compose associatively, and the closure of the class functions under composition is small, so
a function is one byte and a composition one lookup: a blocked scan composes all prefixes of a slice of texts in numpy and
gives the state before every code point, and with it all boundaries, at once. The first code point of a text resets the
state, so many texts share a scan.

The slices between boundaries are made distinct, and each distinct one is merged once and remembered by the worker: as the
library does, a slice that is a token is that token, any other is merged pair by pair, least rank first, the leftmost of
equal ones first. All new slices of up to SHORT bytes are merged together, one merge of each a round; longer ones with a
heap, so that a slice of n bytes costs n log n. Offsets of the ids are kept; decoding gathers the ids' bytes and cuts them by these offsets.

Which code points are letters, numbers or white space is read once per worker from the encoding library itself, whose
Unicode version may differ from Python's.

Null and empty texts have no ids. Special tokens' strings are ordinary text. Bytes that are no valid UTF-8 are read as
U+FFFD. A text is encoded whole; one longer than a slice is a slice of its own, whose arrays take some 40 bytes per byte of
text. Repeated rows each give a row, null ids as null; other columns are kept by `encode` and ignored by `round_trip`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, slices, text_column

#: Bytes of text per slice, code points per block of the scan, longest slice between boundaries that is merged with others.
SLICE = 1 << 21
BLOCK = 64
SHORT = 64
#: Distinct slices between boundaries that a worker remembers, and their bytes; a full cache starts anew.
CACHE_PIECES = 1_000_000
CACHE_BYTES = 128 << 20

# Classes of code points, given what follows: a blank or other white space before something else, white space before
# white space or the end, an apostrophe that opens a contraction of one or of two letters.
LETTER, NUMBER, OTHER, BLANK, SPACE, SPACES, SHORT_FORM, LONG_FORM = range(8)
# States: nothing to join, inside a run of letters, numbers, others or white space, after a blank that joins what
# follows, and inside a contraction with one or two letters to come.
_FREE, _LETTERS, _NUMBERS, _OTHERS, _SPACES, _JOIN, _ONE, _TWO = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of this class, and whether a slice begins at it."""
    if kind == LETTER:
        if state == _TWO:
            return _ONE, False
        if state == _ONE:
            return _FREE, False
        return _LETTERS, state not in (_LETTERS, _JOIN)
    if kind == NUMBER:
        return _NUMBERS, state not in (_NUMBERS, _JOIN)
    if kind in (OTHER, SHORT_FORM, LONG_FORM):
        if state in (_OTHERS, _JOIN):
            return _OTHERS, False
        return {OTHER: _OTHERS, SHORT_FORM: _ONE, LONG_FORM: _TWO}[kind], True
    if kind == SPACES:
        return _SPACES, state != _SPACES
    return (_JOIN if kind == BLANK else _FREE), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the classes' functions (those of a text's first code point after them), their compositions by code
    (second applied after first), the state each sends each state to, and boundaries by state and class."""
    states, kinds = range(8), range(8)
    functions = [tuple(_step(s, k)[0] for s in states) for k in kinds]
    first = [(f[_FREE],) * 8 for f in functions]
    known = {tuple(states): 0}
    for f in functions + first:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in functions + first:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    after = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    codes = np.array([known[f] for f in functions + first], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in kinds] for s in states])
    return codes, compose, after, starts


def scan(codes: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all functions before each place (an exclusive scan; code 0 is the identity)."""
    n = len(codes)
    if n <= BLOCK:
        out, total = np.zeros(n, np.uint8), 0
        for i, c in enumerate(codes.tolist()):
            out[i] = total
            total = compose[total, c]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = codes
    table = padded.reshape(blocks, BLOCK).T.copy()  # a row per place within a block
    total = np.zeros(blocks, np.uint8)
    flat, width = compose.reshape(-1), len(compose)
    for row in table:
        now = flat[total.astype(np.int32) * width + row]
        row[:] = total
        total = now
    carry = scan(total, compose)
    return flat[carry.astype(np.int32) * width + table].T.reshape(-1)[:n]


@cache
def base_classes() -> np.ndarray:
    """Class of every code point, white space as SPACE, contractions unknown."""
    import tiktoken

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices begin among the code points of texts that begin at `first` (ascending, no text empty)."""
    n = len(points)
    kind = base_classes()[points]
    space = kind == SPACE
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    last = opens[1:]  # a text ends here
    # White space before more of it, or at the end of its text, or else before something else.
    more = np.empty(n, bool)
    more[:-1] = space[1:]
    more[-1:] = False
    kind[space & (more | last)] = SPACES
    kind[space & ~more & ~last & (points == 32)] = BLANK
    # Apostrophes: one or two of these letters follow in the same text.
    at = np.flatnonzero((points == 39) & ~last)
    if len(at):
        one = points[at + 1]
        kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT_FORM
        two = at[(at + 2 < n)]
        two = two[~last[two + 1]]
        a, b = points[two + 1], points[two + 2]
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[two[long]] = LONG_FORM
    codes, compose, after, starts = automaton()
    functions = codes[kind]
    functions[first] = codes[kind[first] + 8]
    state = after[scan(functions, compose), _FREE]
    out = starts[state, kind]
    out[first] = True
    return out


class Pairs:
    """Which pairs of ids may merge: the rank of every pair whose bytes together are a token."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(rank, np.int32)[order], self.NONE)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(left.shape, self.NONE)
        real = (left >= 0) & (right >= 0)
        key = left[real].astype(np.int64) * self.width + right[real]
        at = np.searchsorted(self.keys, key)
        out[real] = np.where(self.keys[at] == key, self.rank[at], self.NONE)
        return out

    def merge(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of slices of one to SHORT bytes that are no tokens: all at once, each by one merge a round.

        Gives numbers of pieces, their counts of ids, and their ids one after the other, in any order of pieces.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 32), (32, SHORT)):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            for a in range(0, len(of), 1 << 14):
                yield from self._merge(pieces, of[a : a + (1 << 14)], lengths, high)

    def _merge(self, pieces: list[bytes], of: np.ndarray, lengths: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join([pieces[i].ljust(wide, b"\0") for i in of.tolist()]), np.uint8).reshape(len(of), wide)
        ids = np.where(np.arange(wide) < lengths[of][:, None], self.bytes[data], np.int32(-1))
        ids = np.concatenate((ids, np.full((len(of), 2), -1, np.int32)), axis=1)
        ranks = self.of(ids[:, :-1], ids[:, 1:])
        place = np.arange(wide + 2)
        while len(of):
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(of)), j]
            done = best == self.NONE
            if done.any():
                left = ids[done]
                real = left >= 0
                yield of[done], real.sum(axis=1), left[real]
                of, ids, ranks, j, best = of[~done], ids[~done], ranks[~done], j[~done], best[~done]
            row = np.arange(len(of))
            # The pair's left id becomes the merged one, all that follows moves up by one.
            ids[row, j] = best
            ids = np.take_along_axis(ids, np.minimum(place + (place > j[:, None]), wide + 1), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(place[:-1] + (place[:-1] > j[:, None]), wide), axis=1)
            ranks[row, j] = self.of(best, ids[row, j + 1])
            inner = j > 0
            ranks[row[inner], j[inner] - 1] = self.of(ids[row[inner], j[inner] - 1], best[inner])


def _merge_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    stop = list(range(1, n + 1))  # end of the part that begins here
    back = list(range(-1, n - 1))  # begin of the part before
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or stop[i] >= n or ranks.get(piece[i : stop[stop[i]]]) != r:
            continue
        j = stop[i]
        alive[j] = 0
        stop[i] = stop[j]
        if stop[i] < n:
            back[stop[i]] = i
            if (r := ranks.get(piece[i : stop[stop[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if i and (r := ranks.get(piece[back[i] : stop[i]])) is not None:
            heapq.heappush(heap, (r, back[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class ByteEncoder:
    """Ids of whole texts, and their texts again, for one file of ranks."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pairs = Pairs(self.ranks)
        by_id = sorted((i, t) for t, i in self.ranks.items())
        lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        lengths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.lengths, self.token_at = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.used = 0, 0
        self.first, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        n, m = len(self.known), len(pieces)
        while n + m > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        whole, long, short = [], [], []
        for i, p in enumerate(pieces):
            (whole if p in self.ranks else long if len(p) > SHORT else short).append(i)
        self._hold(n + np.array(whole, np.int64), np.ones(len(whole), np.int64), np.array([self.ranks[pieces[i]] for i in whole], np.uint32))
        for i in long:
            got = _merge_heap(pieces[i], self.ranks)
            self._hold(np.array([n + i]), np.array([len(got)]), np.array(got, np.uint32))
        numbers = n + np.array(short, np.int64)
        for of, counts, ids in self.pairs.merge([pieces[i] for i in short]):
            self._hold(numbers[of], counts, ids)
        self.held += sum(map(len, pieces))
        self.known.update(zip(pieces, range(n, n + m), strict=True))

    def _hold(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.first[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the n + 1 offsets of the texts into them."""
        try:
            points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            texts = [flat[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return self.encode(*byte_view(pa.array(texts, pa.large_binary())))
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        at = np.flatnonzero((flat & 0xC0) != 0x80)  # the bytes at which code points begin
        starts = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        begins = at[boundaries(points, np.searchsorted(at, starts))]
        cuts = np.append(begins, len(flat)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_PIECES or self.held > CACHE_BYTES:
            self._clear()
        known = self.known
        if new := [p for p in distinct if p not in known]:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        counts = self.count[number]
        before = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.first[number] - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, one after the other, and the n + 1 offsets of the texts into them."""
        counts = self.lengths[ids]
        before = np.concatenate(([0], np.cumsum(counts)))
        return self.token_bytes[np.repeat(self.token_at[ids] - before[:-1], counts) + np.arange(before[-1])], before[offsets]


@cache
def encoder(vocabulary: str) -> ByteEncoder:
    """The worker's encoder, kept between tasks."""
    return ByteEncoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        flat, offsets = byte_view(text_column(batch, text))
        for a, b in slices(offsets, SLICE):
            yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, name: str = "ids") -> DataFrame:
    """All rows of df and a column of their ids. A column of that name is replaced."""
    vocabulary = vocabulary or default_vocabulary()
    rows = df.drop(name) if name != text else df

    def run(batches):
        for batch, flat, offsets in _slices(batches, text):
            ids, at = encoder(vocabulary).encode(flat, offsets)
            for a in range(batch.num_rows):  # one row a batch: lists of any total length
                yield pa.RecordBatch.from_arrays([*batch.slice(a, 1).columns, pa.array([ids[at[a] : at[a + 1]].astype(np.int32)], pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None, name: str = "text") -> DataFrame:
    """All rows of df and a binary column of the bytes that their ids stand for; null ids give no bytes."""
    vocabulary = vocabulary or default_vocabulary()
    rows = df.drop(name)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for i in range(batch.num_rows):
                x = np.asarray(column[i].values if column[i].is_valid else [], np.int64)
                data, _ = encoder(vocabulary).decode(x, np.array([0, len(x)]))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data.tobytes()], pa.binary())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.BinaryType())]))


def round_trip(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row its number of ids, their sha256 as little-endian 32-bit integers, and the sha256 of the decoded bytes."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        for batch, flat, offsets in _slices(batches, "text"):
            e = encoder(vocabulary)
            ids, at = e.encode(flat, offsets)
            data, cut = e.decode(ids, at)
            ids = ids.astype("<u4", copy=False)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                    "decoded_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                }
            )

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
