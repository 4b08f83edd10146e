"""Ids of public tokenizers for batches of whole texts, by way of a cache of chunks.

Both tokenizers first split a text with a pattern, and merges never cross its bounds. Some
bounds show in the bytes alone: before white space that follows a visible character, and
between an ASCII letter and a punctuation mark other than the apostrophe. Texts are cut
there, each distinct chunk is given to the library once, and the ids of a batch are gathered
from the cache. The cache of a worker holds a bounded number of chunks and ids and starts anew when full.

As the vocabularies' own description asks for, strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from . import _text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _SOLID & ~_LETTER
_MARK[ord("'")] = False
_MARK[48:58] = False
#: Chunks in a worker's cache at most.
MOST_CHUNKS = 1_000_000
#: Ids in it at most, beside those of the piece at hand.
MOST_IDS = 8_000_000
#: Chunks given to the library at once.
AT_ONCE = 4096


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each document, and at bounds that any of the patterns has."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        solid = _SOLID[before]
        # The last byte of a character of two, three or four bytes. No white space begins with these bytes: they are
        # all but C2, E1, E2 and E3.
        tail = (before & 0xC0) == 0x80
        solid[1:] |= tail[1:] & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        solid[2:] |= tail[2:] & ((data[:-3] == 0xE0) | ((data[:-3] >= 0xE4) & (data[:-3] <= 0xEF)))
        solid[3:] |= tail[3:] & (data[:-4] >= 0xF0)
        cut[1:] = (T.SEPARATOR[here] & solid) | (_MARK[here] & _LETTER[before])
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


class _Cache:
    """From a chunk's hash to its ids; open addressing over numpy arrays."""

    def __init__(self, dtype):
        self.keys = np.zeros(1 << 16, np.uint64)
        self.places = np.zeros(1 << 16, np.int32)
        self.begin, self.ids, self.n, self.n_ids = np.zeros(1 << 15, np.int64), np.zeros(1 << 18, dtype), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1. A stored hash is never 0."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            have = self.keys[slot[todo]]
            hit = have == h[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (have != 0)]
            slot[todo] = (slot[todo] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            self.places[slot[free]] = places[free]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def add(self, h: np.ndarray, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = self.n_ids + int(sizes.sum())
        if total > len(self.ids):
            self.ids = np.resize(self.ids, max(total, 2 * len(self.ids)))
        if self.n + len(h) + 1 > len(self.begin):
            self.begin = np.resize(self.begin, max(self.n + len(h) + 1, 2 * len(self.begin)))
        self.ids[self.n_ids : total] = np.fromiter(chain.from_iterable(lists), self.ids.dtype, total - self.n_ids)
        self.begin[self.n + 1 : self.n + len(h) + 1] = self.n_ids + np.cumsum(sizes)
        places = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.n_ids = self.n + len(h), total
        if 2 * self.n > len(self.keys):
            old, at = self.keys, self.places
            size = len(old)
            while size < 4 * self.n:
                size *= 2
            self.keys, self.places = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(old[old != 0], at[old != 0])
        self._put(h, places)


class Chunked:
    """ids(piece): the ids of a piece's documents end to end, and each document's bounds."""

    def __init__(self, encode, dtype, lower: bool = False):
        self.encode, self.dtype, self.lower = encode, dtype, lower
        self.cache = _Cache(dtype)

    def ids(self, piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
        data = piece.data
        if self.lower and len(data):
            lowered = T.LOWER[data]
            marked = np.append((data[1:] & 0xFE) == 0xCC, False)  # a letter and a combining mark may compose otherwise in lower case
            data = np.where(marked, data, lowered)
        begin = chunk_starts(data, piece.at)
        end = np.append(begin[1:], len(data))
        if self.lower and len(begin):  # white space is dropped: fewer distinct chunks without what leads one
            begin = begin + (T.SEPARATOR[data[begin]] & (end - begin > 1))
        at = np.searchsorted(begin, piece.at[:-1])
        at = np.append(at, len(begin))
        h = T.Hashes(data).of(begin, end)
        h[h == 0] = 1
        if self.cache.n > MOST_CHUNKS or self.cache.n_ids > MOST_IDS:
            self.cache = _Cache(self.dtype)
        place = self.cache.find(h)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            raw = data.tobytes()
            self.cache.add(new, self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]))
            place[miss] = self.cache.find(h[miss])
        start = self.cache.begin[place]
        size = self.cache.begin[place + 1] - start
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        out = self.cache.ids[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
        return out, bounds[at]


def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def _chunked(path: str, lower: bool) -> Chunked:
    library = _library(path)

    def encode(chunks: list[str]) -> list[list[int]]:
        # the library's own results are large, so few are held at once
        return [x.ids for lo in range(0, len(chunks), AT_ONCE) for x in library.encode_batch_fast(chunks[lo : lo + AT_ONCE], add_special_tokens=False)]

    return Chunked(encode, np.uint16 if library.get_vocab_size() <= 1 << 16 else np.uint32, lower=lower)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> Chunked:
    """A lower-casing BPE with word ends, whose pattern drops white space."""
    return _chunked(path, True)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Chunked:
    """A byte-level BPE."""
    return _chunked(path, False)
