"""Encoding with public tokenizers, with a worker-wide cache of words."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers; a full cache starts anew.
CACHE_WORDS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts for tokenizers that drop white space between words.

    Such a tokenizer encodes a text as its pieces between blanks or line breaks, one after the other: white space is
    never part of a token, and neither normalisation nor splitting looks across it. So each distinct piece is encoded
    by the library once, and a text is put together from remembered pieces. A-Z is lowered first, as the tokenizer
    itself does. Strings of special tokens are encoded as the library encodes them in a text.
    """

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(vocabulary), cache_words
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, pieces: list[str]) -> None:
        got = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        of = np.array(got.word_ids, np.int64) if len(ids) else np.zeros(0, np.int64)
        n, m = len(self.known), len(pieces)
        while n + m > len(self.first):
            self.first, self.count = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        counts = np.bincount(of, minlength=m)
        self.count[n : n + m] = counts
        self.first[n : n + m] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of the texts."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = lists.flatten()
        # Special tokens are found before the tokenizer lowers a text.
        pieces = pc.if_else(pc.match_substring(flat, "<|"), flat, pc.ascii_lower(flat)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(self.known) + len(words) > self.cache_words:
            self.clear()
        known = self.known
        if new := [w for w in words if w not in known]:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[pieces.indices.to_numpy()]
        counts = self.count[number].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(self.first[number] - before[:-1], counts) + np.arange(before[-1])
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return self.ids[at], before[cuts]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]
