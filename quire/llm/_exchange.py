"""One round trip between batches of documents and buckets of hashes, in packed rows.

Documents are dealt into batches by a hash of doc_id and text. Each batch sends every bucket
of hashes one row with its distinct hashes there, ascending, and what goes with them; a bucket
sees a hash's entries of all batches and answers each row in its order; the batch, made anew
from the same rows, takes the answers up. A hash is one entry per batch however frequent it is, so
no bucket is hot. An entry takes about five bytes instead of the twenty-odd of a row, and rows
are at most as many as entries. Batches and buckets are as many as the bytes of text ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch, and of text behind a bucket, about.
BATCH_BYTES = 6_000_000
BUCKET_BYTES = 4_000_000
#: Bits of a hash beyond those that number the bytes: two to this power times rarer than bytes are false meetings.
SPARE_BITS = 16


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: small numbers leave planes of zeros, which take no room."""
    return b"".join(len(z).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + z for raw in map(_planes, arrays) for z in (pa.compress(raw, "zstd", asbytes=True),))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, whole = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        raw = pa.decompress(data[at + 8 : at + 8 + size], whole, "zstd", asbytes=True) if whole else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1))
        at += 8 + size
    return out


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


class Buckets:
    """How hashes fall into buckets: by their first bits, so that ascending hashes are buckets in order."""

    def __init__(self, size: int, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, spare_bits: int = SPARE_BITS):
        self.batches = 1 + size // batch_bytes
        self.bits = max((size // bucket_bytes).bit_length(), 1)
        #: Hashes keep so many of their first bits: enough for as many words as there can be bytes.
        self.kept = min(64, max(size, 1).bit_length() + spare_bits)

    def kept_of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.kept)

    def parts(self, ascending: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bucket, begin and end of the kept hashes of each bucket that has some."""
        bucket = ascending >> np.uint64(self.kept - self.bits)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        ends = np.append(first[1:], len(bucket))[: len(first)]
        yield from zip(bucket[first].tolist(), first.tolist(), ends.tolist(), strict=True)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def from_deltas(delta: np.ndarray) -> np.ndarray:
    return np.cumsum(delta, dtype=np.uint64)


def totals(rows: list[bytes]) -> list[bytes]:
    """An answer for rows of ascending hashes and counts: of each hash, the sum of its counts in all rows."""
    parts = [unpacked(r, "<u8", "<u4") for r in rows]
    every, count = np.concatenate([from_deltas(h) for h, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(every)
    first = np.append(True, np.diff(every[order]) != 0)[: len(every)]
    total = np.minimum(np.add.reduceat(count[order], np.flatnonzero(first)), 2**32 - 1)
    out = np.empty(len(every), "<u4")
    out[order] = total[np.cumsum(first) - 1]
    return [packed(part) for part in np.split(out, np.cumsum([len(h) for h, _ in parts])[:-1])]


ROWS = "bucket long, batch long, packed binary"


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "batch", "packed"])


def round_trip(docs: DataFrame, buckets: Buckets, send: Callable[[pa.Table], list[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]], take: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str, by: tuple[str | Column, ...] = ("doc_id", "text")) -> DataFrame:
    """What ``take`` makes of each batch of docs (which has a text) and the answers to what it sent.

    send: a batch's rows of (bucket, packed); answer: of one bucket's packed rows, an answer to each.
    """
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64(*by), F.lit(buckets.batches)))

    def sent(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        return rows_of([(bucket, batch, data) for bucket, data in send(table)])

    def answered(table: pa.Table) -> pa.Table:
        found = answer(table.column("packed").to_pylist())
        return pa.Table.from_arrays([table.column("bucket"), table.column("batch"), pa.array(found, pa.binary())], ["bucket", "batch", "packed"])

    def taken(left: pa.Table, right: pa.Table) -> pa.Table:
        return take(left, dict(zip(right.column("bucket").to_pylist(), right.column("packed").to_pylist(), strict=True)))

    answers = dealt.groupBy("batch").applyInArrow(sent, ROWS).groupBy("bucket").applyInArrow(answered, ROWS)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(taken, schema)
