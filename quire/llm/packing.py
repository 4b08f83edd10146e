"""Best-fit packing planned over a histogram of lengths (operator 7).

Documents become pieces of at most ``capacity`` tokens. Only the counts of pieces by length
reach the driver, at most ``capacity`` rows. :func:`plan` runs best-fit decreasing over these
counts: bins with the same room are one group, so the plan has a few thousand rows whatever
the number of documents. A row says: the pieces of one length with ranks lo to lo+count take
their places, ``per`` in a sequence, from sequence ``base`` and offset ``start`` on. Pieces then
get their rank within their length and join the plan.

A length may hold a large part of all pieces, so ranks are dealt in two steps: within a length
and a hashed part of it, and then from the counts of the parts before.

Defined results: a null or empty text is one piece of the end id alone; repeated rows are
packed each for itself; doc_id is a whole number or null; of equal lengths the order decides who takes which slot; an empty table gives
no rows; columns other than doc_id and text are ignored; a long text is cut into as many pieces as it needs, its ids in memory at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text as T
from . import _tokens
from ._store import written

CAPACITY = 1024
#: Pieces in one hashed part of a length, about.
PART_ROWS = 50_000
LEAST_PARTS = 64
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: full ones, and what is over comes first."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document, with its ids as little-endian 32-bit integers if kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.byte_bpe(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part in T.pieces(batch.column("text")):
                ids, at = encoder.ids(part)
                doc, rows = batch.column("doc_id").slice(part.lo, part.docs).to_pylist(), []
                for k in range(part.docs):
                    own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4").tobytes()
                    start = 0
                    for number, length in enumerate(cut(len(own) // 4, capacity)):
                        raw = own[4 * start : 4 * (start + length)]
                        rows.append((doc[k], number, start, length, zlib.crc32(raw), raw if keep_ids else None))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES_SCHEMA)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, lo, count, base, per, start) and the number of sequences.

    Best-fit decreasing: longest first, each into the fullest sequence that has room.
    """
    rows, sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free places in a sequence: groups of (base, number)
    for length in sorted(counts, reverse=True):
        lo, left = 0, counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                free, base = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            else:
                base, number = room[free].pop()
                if not room[free]:
                    del room[free]
            per = min(free // length, left)
            used = min(number, left // per)
            rows.append((length, lo, used * per, base, per, capacity - free))
            lo, left = lo + used * per, left - used * per
            if free > per * length:
                room.setdefault(free - per * length, []).append((base, used))
            if used < number:
                room.setdefault(free, []).append((base + used, number - used))
    return rows, sequences


PLAN_SCHEMA = S.StructType([S.StructField(c, S.LongType()) for c in ("length", "lo", "count", "base", "per", "at")])


def pack(items: DataFrame, *, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """items with sequence_id and offset. items has ``length`` (1 to capacity) and the order
    columns, and should be a written table, as it is read twice."""
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    spark = items.sparkSession
    parts = max(LEAST_PARTS, sum(counts.values()) // PART_ROWS)
    # By all columns, so that rows without doc_id are dealt out as well; rows equal in all of them may swap places.
    rest = [c for c, kind in items.dtypes if c not in order and kind != "binary"]
    dealt = items.withColumn("_part", F.pmod(F.xxhash64(*order, *rest), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order, *rest)) - 1)
    ranked = ranked.join(sizes, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slots = spark.createDataFrame(rows, PLAN_SCHEMA).withColumnRenamed("length", "_length")  # bounded: a few rows for each length
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("lo") + F.col("count")))
    rank = F.col("_rank") - F.col("lo")
    return found.select(
        *(c for c in items.columns),
        (F.col("base") + F.floor(rank / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(rank, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents and their places."""
    cut_up = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    return pack(written(cut_up if keep_ids else cut_up.drop("ids"), "pieces"), capacity=capacity)
