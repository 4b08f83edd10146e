"""Stupid-backoff scores from n-gram counts of the whole corpus (operator 5).

A word after the two before it scores c(xyz) / c(xy) if that trigram occurs at least
``least`` times in the corpus, else 0.4 times c(yz) / c(y) likewise, else 0.4^2 c(z) / N. Counts
are over all documents; N is the number of all words. A document's score is the mean
natural logarithm over its words. As a document's own words are in the corpus too, every n-gram of it occurs
once: ``least`` is 2, so that an n-gram counts as seen where it occurs besides the place at hand. With 1 nothing ever backs off.

Count tables and exploded n-grams are partitioned by a hash of the n-gram, so that they
meet in one bucket, in packed rows (``_exchange``): a batch of documents explodes its n-grams, counts them, and sends each bucket one
row with its sorted hashes and counts. A bucket adds up the counts of all batches, which is
its part of the count tables, and joins them to each batch's n-grams: it answers each row with
the total counts, in the same order. The batch joins the answers to its words and sums by
document. An n-gram however frequent is one entry per batch, so no bucket is hot, and what
is gathered grows with the input. As rows, the exploded n-grams of three orders would be some twenty times the input.

Defined results: words are those between white space, as written; a null or wordless text has
n_words 0 and a null score; repeated rows are all counted and each scored; a null doc_id is
scored like another; doc_id is a whole number; an empty table gives no rows; columns other than doc_id and text are ignored; a long
text is in one batch, in memory: some hundred bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from . import _text as T

ORDER = 3
LEAST = 2
BACKOFF = 0.4
#: Bytes of text in a batch, about.
BATCH_BYTES = 6_000_000
#: Counts are to be those of the n-grams, so two of one hash should not be, in any table.
SPARE_BITS = 24


def _ngrams(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, and whether it begins in its document."""
    gram, whole = T.grams(w, n)
    out, known = np.zeros_like(gram), np.zeros_like(whole)
    out[n - 1 :], known[n - 1 :] = gram[: len(gram) - n + 1], whole[: len(gram) - n + 1]
    return out ^ T.mix(np.uint64([n])), known


def pack(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes]:
    """Ascending hashes and their counts as one value."""
    return (X.packed(X.deltas(hashes), counts.astype("<u4")),)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    delta, counts = X.unpacked(data, "<u8", "<u4")
    return X.from_deltas(delta), counts


class Exploded:
    """The n-grams of a batch: where each word's n-grams lie among the distinct ones, which ascend."""

    def __init__(self, column: pa.Array, order: int, buckets: X.Buckets):
        hashes, known, size = [[] for _ in range(order)], [[] for _ in range(order)], []
        for piece in T.pieces(column):
            w = T.words(piece)
            size.append(np.diff(w.at))
            for n in range(order):
                h, k = _ngrams(w, n + 1)
                hashes[n].append(buckets.kept_of(h[k]))
                known[n].append(k)
        self.at = np.append(0, np.cumsum(np.concatenate(size))) if size else np.zeros(1, np.int64)
        self.n = int(self.at[-1])
        self.known = [np.concatenate(k) if k else np.zeros(0, bool) for k in known]
        flat = [h for of in hashes for h in of]
        every = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        self.distinct, place, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.places = np.split(place, np.cumsum([int(k.sum()) for k in self.known])[:-1])


def _scores(e: Exploded, total: np.ndarray, words: int, least: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document and the sum of their log scores."""
    counts = []
    for known, place in zip(e.known, e.places, strict=True):
        c = np.zeros(e.n, np.int64)
        c[known] = total[place]
        counts.append(c)
    log = np.log(counts[0] / words) if e.n else np.zeros(0)
    for n in range(2, len(counts) + 1):
        own, context = counts[n - 1], np.append(0, counts[n - 2][:-1])
        use = own >= least
        log = np.where(use, np.log(np.maximum(own, 1) / np.maximum(context, 1)), log + np.log(backoff))
    sums = np.append(0.0, np.cumsum(log))
    return np.diff(e.at), sums[e.at[1:]] - sums[e.at[:-1]]


def scores(docs: DataFrame, *, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = X.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (the sum) and score (the mean) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")).first()
    buckets, words = X.Buckets(size["bytes"], batch_bytes, bucket_bytes, SPARE_BITS), size["words"]

    def send(table: pa.Table) -> list[tuple[int, bytes]]:
        e = Exploded(table.column("text"), order, buckets)
        return [(k, *pack(e.distinct[lo:hi], e.counts[lo:hi])) for k, lo, hi in buckets.parts(e.distinct)]

    def take(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        e = Exploded(table.column("text"), order, buckets)
        totals = np.zeros(len(e.distinct), np.int64)
        for k, lo, hi in buckets.parts(e.distinct):
            totals[lo:hi] = X.unpacked(answers[k], "<u4")[0]
        n, total = _scores(e, totals, max(words, 1), least, backoff)
        some = n > 0
        mean = pa.array(total / np.maximum(n, 1), mask=~some)
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total, mask=~some), mean], ["doc_id", "n_words", "log_score", "score"])

    return X.round_trip(docs, buckets, send, X.totals, take, "doc_id long, n_words long, log_score double, score double")
