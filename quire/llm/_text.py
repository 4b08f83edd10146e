"""Words, lines and hashes over the byte buffers of Arrow string columns.

Everything here works on whole batches with numpy: a batch's texts lie end to end in one
buffer, so word bounds, word hashes and n-gram hashes of thousands of documents come from a
few array operations. Large batches are split at document bounds into pieces of about
PIECE bytes, which bounds memory; one text longer than that is a piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1_000_000
#: A piece has at most so many documents, so that an index into it fits in KEY_BITS.
MOST_DOCS = 4096
KEY_BITS = np.uint64(52)

# A worker lives on after its stage: what it frees goes back to the system instead of staying in its heap.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


@dataclass
class Piece:
    """Consecutive documents of a batch: rows lo to hi, their bytes, and bounds in these."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    @property
    def docs(self) -> int:
        return self.hi - self.lo


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    data, at = texts(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + size, "right")) - 1, lo + 1), lo + MOST_DOCS, n)
        yield Piece(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set within each pair of bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch of set flags; none crosses a document's bound."""
    n = len(inside)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < n]
    begin[first] = inside[first]
    last = at[1:][at[1:] > 0] - 1
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Hashes:
    """64-bit hashes of any byte ranges of a buffer, from one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power("up", _BASE, n), out=self.sums[1:])
        self.back = _power("down", pow(_BASE, -1, 2**64), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


@dataclass
class Words:
    """Words of a piece: byte bounds, hashes, and at[d]:at[d+1] as the words of document d."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray


def words(piece: Piece, lower: bool = False) -> Words:
    """Words are maximal runs without the bytes 0x20 and 0x09-0x0D; lower: A-Z as a-z."""
    data = LOWER[piece.data] if lower else piece.data
    begin, end = runs(~SEPARATOR[data], piece.at)
    return Words(begin, end, Hashes(data).of(begin, end), np.searchsorted(begin, piece.at))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that begins at each word, and whether it ends in its document."""
    count = len(w.hash)
    out, whole = np.zeros(count, np.uint64), np.zeros(count, bool)
    if count >= n:
        tail = count - n + 1
        total = np.zeros(tail, np.uint64)
        for k in range(n):
            total = total * np.uint64(_BASE) + w.hash[k : k + tail]
        out[:tail] = mix(total)
        whole[:tail] = True
    for back in range(1, n):  # the last n-1 words of each document begin no n-gram
        late = w.at[1:] - back
        whole[late[late >= w.at[:-1]]] = False
    return out, whole


def doc_of(at: np.ndarray) -> np.ndarray:
    """The document of each element, from the documents' bounds."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def keyed(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Document and value in one sortable 64-bit key; 52 bits of the value stay."""
    return (doc.astype(np.uint64) << KEY_BITS) | (value >> (np.uint64(64) - KEY_BITS))


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
