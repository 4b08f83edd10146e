"""Token ids as files: canonical length-limited Huffman codes over global counts (operator 9).

The file format is a folder of two Parquet tables, written by Spark's own committer, so it needs no shared
local folder and a lost task is written again. ``code`` is one row: the ids that occur with their code lengths, the stride
and the end id, which is all that a reader needs. ``blocks`` has one row for each block of whole documents in ascending
doc_id order. A block holds

* ``part``, ``block``: its place in the order of all blocks,
* ``doc_ids``, ``sizes``: its documents and their numbers of ids,
* ``bits``: the codes, most significant bit first,
* ``checkpoints``: the bit offset of each STRIDE-th id, so a reader can start there.

Code lengths come from the counts over the whole corpus by package-merge with at most
MOST_BITS bits; the codes are canonical, so the lengths alone make the decoding table. A
block decodes by itself: all its checkpoints advance together, one id a step, through one
table look-up on the next MOST_BITS bits.

Defined results: a null or empty text has the end id alone; doc_id is a whole number, a null one sorts first; rows
that repeat a doc_id are ordered by their ids; an empty table writes no block; columns other
than doc_id and text are ignored; a long text is a block of its own, held in memory whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from . import _tokens
from ._store import dropped, shared, written

MOST_BITS = 20
STRIDE = 256
BLOCK_IDS = 1 << 17
IDS_SCHEMA = "doc_id long, n_ids long, ids binary"
CODE_SCHEMA = "stride int, end_id int, ids binary, lengths binary"
BLOCK_SCHEMA = "part int, block long, n_ids long, doc_ids binary, sizes binary, bits binary, checkpoints binary"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Ids of each whole text with the end id, as little-endian 16-bit integers (the vocabulary is below 2^16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.word_bpe(tokenizer)
        for batch in batches:
            for part in T.pieces(batch.column("text")):
                ids, at = encoder.ids(part)
                assert encoder.dtype == np.uint16
                own = [np.append(ids[at[k] : at[k + 1]], end_id).astype("<u2").tobytes() for k in range(part.docs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.lo, part.docs), pa.array(np.diff(at) + 1), pa.array(own, pa.binary())], ["doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS_SCHEMA)


def id_counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            column = batch.column("ids")
            raw = np.frombuffer(b"".join(column.to_pylist()), "<u2")
            total += np.bincount(raw, minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return {r["id"]: r["n"] for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Optimal lengths of at most ``most`` bits: package-merge, level by level."""
    leaves = sorted((n, i) for i, n in counts.items() if n > 0)
    if not leaves:
        return {}
    if len(leaves) == 1:
        return {leaves[0][1]: 1}
    if len(leaves) > 1 << most:
        raise ValueError("more symbols than codes")
    weight = np.array([n for n, _ in leaves], np.int64)
    size = len(weight)
    # For each level, which merged items are leaves; a package is two neighbours of the level below.
    kinds, items = [np.ones(size, bool)], weight
    for _ in range(most - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        kinds.append(order < size)
        items = both[order]
    depth = np.zeros(size, np.int64)
    take = 2 * size - 2
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    return {i: int(d) for (_, i), d in zip(leaves, depth, strict=True)}


class Code:
    """A canonical code: shorter first, and by id within a length."""

    def __init__(self, lengths: dict[int, int]):
        self.most = max(lengths.values(), default=1)
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        top = max(lengths, default=0) + 1
        self.length, self.code = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        self.table = np.zeros(1 << self.most, np.uint32)  # the id above the length in 6 bits
        code = last = 0
        for i in order:
            code <<= lengths[i] - last
            last = lengths[i]
            self.length[i], self.code[i] = last, code
            first = code << (self.most - last)
            self.table[first : first + (1 << (self.most - last))] = (i << 6) | last
            code += 1

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of each stride-th of them."""
        size = self.length[ids]
        end = np.cumsum(size)
        begin = end - size
        total = int(end[-1]) if len(end) else 0
        # A code of at most 32 bits lies in two neighbouring 32-bit words, which are sums of such parts.
        word, shift = begin >> 5, (64 - (begin & 31) - size).astype(np.uint64)
        value = self.code[ids] << shift
        high, low = (value >> np.uint64(32)).astype(np.uint32), value.astype(np.uint32)
        out = np.zeros((total >> 5) + 2, np.uint32)
        if len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            at = word[first]
            out[at] |= np.bitwise_or.reduceat(high, first)
            out[at + 1] |= np.bitwise_or.reduceat(low, first)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], begin[::stride].astype("<u8")

    def decode(self, bits: bytes, checkpoints: np.ndarray, total: int, stride: int = STRIDE) -> np.ndarray:
        """All ids of a block; every checkpoint is a lane, and a step decodes an id in each."""
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
        n = len(raw) - 7
        window = np.zeros(n, np.uint64)  # the 40 bits that begin at each byte
        for k in range(5):
            window = (window << np.uint64(8)) | raw[k : k + n]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), stride), np.uint32)
        keep = np.uint64((1 << self.most) - 1)
        for step in range(min(stride, total)):
            lanes = len(at) if (len(at) - 1) * stride + step < total else len(at) - 1
            here = at[:lanes]
            found = self.table[((window[here >> 3] >> (np.uint64(40 - self.most) - (here & 7).astype(np.uint64))) & keep).astype(np.int64)]
            out[:lanes, step] = found >> 6
            at[:lanes] += found & 63
        return out.reshape(-1)[:total]


def write_file(ids: DataFrame, lengths: dict[int, int], path: str, end_id: int) -> None:
    """Write the file: ids sorted by doc_id over range partitions, each encoded in blocks.

    ids should be a written table: choosing the ranges reads its doc_id column only.
    """
    code = Code(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names = ["part", "block", "n_ids", "doc_ids", "sizes", "bits", "checkpoints"]
        for batch in batches:
            size, lo = batch.column("n_ids").to_numpy(), 0
            while lo < len(size):
                total = np.cumsum(size[lo:])
                hi = lo + max(1, int(np.searchsorted(total, BLOCK_IDS, "right")))
                own = np.frombuffer(b"".join(batch.column("ids").slice(lo, hi - lo).to_pylist()), "<u2")
                bits, checkpoints = code.encode(own)
                doc = batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64())
                # a null doc_id, which sorts first, is the least 64-bit integer in the file
                row = [part, block, len(own), doc.fill_null(NO_ID).to_numpy().astype("<i8").tobytes(), size[lo:hi].astype("<u4").tobytes(), bits, checkpoints.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names)
                block, lo = block + 1, hi

    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_ids", "ids").mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    known = sorted(lengths)
    row = (STRIDE, end_id, np.array(known, "<u4").tobytes(), bytes(lengths[i] for i in known))
    ids.sparkSession.createDataFrame([row], CODE_SCHEMA).coalesce(1).write.parquet(f"{path}/code")


NO_ID = -(2**63)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a file read back: doc_id, start, n_tokens, ids_crc32 and ids."""
    head = spark.read.schema(CODE_SCHEMA).parquet(f"{path}/code").first()
    code, stride = Code(dict(zip(np.frombuffer(head["ids"], "<u4").tolist(), head["lengths"], strict=True))), head["stride"]
    ids_file = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row for each part, of its total; parts are as many as partitions, not as rows.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ids_file.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids_file.select("part", "block", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("before") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), row["n_ids"], stride).astype("<u4")
                size = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                at = np.append(0, np.cumsum(size))
                raw = [ids[at[k] : at[k + 1]].tobytes() for k in range(len(size))]
                doc = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(row["start"] + at[:-1]), pa.array(size), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())], names)

    return ids_file.join(starts, ["part", "block"]).select("n_ids", "doc_ids", "sizes", "bits", "checkpoints", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encoded(docs: DataFrame, tokenizer: str, *, end_id: int = 1, name: str = "token-ids") -> DataFrame:
    """Write the ids of all documents to a new file in the shared folder, and read it back."""
    from uuid import uuid4

    ids = written(token_ids(docs, tokenizer, end_id), "ids")
    lengths = code_lengths(id_counts(ids))
    path = f"{shared(docs.sparkSession)}/{name}-{uuid4().hex}"
    write_file(ids, lengths, path, end_id)
    dropped(ids)
    return read_file(docs.sparkSession, path)
