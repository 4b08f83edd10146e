"""Quality by nearest-neighbour votes over latent-semantic vectors (operator 6).

The terms of a text are its byte trigrams, counted in TERMS hashed places, and two terms of
shape: the share of words like the word before them, and of signs to words. Log counts times inverse document frequency, reduced by a truncated
singular value decomposition of the labelled sample, give the latent vectors. The vectors of
at most ``sample`` labelled documents, so at most ``sample`` x RANK numbers, go to every
executor; each document's cosines with all of them are exact products of blocks, and its
nearest labels vote with their similarity as weight.

The inverse document frequencies are part of the classifier and come from its sample. Defined
results: a null, empty or very short text has a vector of zeros and gets the share of label 1;
equally near neighbours all vote; repeated rows score alike, and a doc_id that repeats among labelled ones teaches once; without labels every score is
0.5; an empty table gives no rows; a long text is counted whole, in memory; only text is an input of a score, and other columns are ignored,
those of the names of the operator's own too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from .language_id import held_out

TERMS = 2048
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3

_PLACE = (np.random.Generator(np.random.PCG64(5)).integers(1, 2**31, (3, 256)) | 1).astype(np.uint32)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("0")
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>!"]] = True


def term_counts(piece: T.Piece) -> np.ndarray:
    """Log counts of terms: documents x TERMS."""
    x, n = _CLASS[piece.data], len(piece.data)
    doc = T.doc_of(piece.at)
    total = np.zeros(piece.docs * TERMS, np.int64)
    if n >= 3:
        h = _PLACE[0][x[:-2]] ^ (_PLACE[1][x[1:-1]] * np.uint32(5)) ^ (_PLACE[2][x[2:]] * np.uint32(25))
        inside = doc[:-2] == doc[2:]
        h = (h ^ (h >> np.uint32(15))) % np.uint32(TERMS - 8)
        total += np.bincount((doc[:-2] * TERMS + h)[inside], minlength=len(total))
    out = np.log1p(total.reshape(piece.docs, TERMS).astype(np.float32))
    # Terms of shape weigh as much as all trigrams do if every word has them.
    length = np.linalg.norm(out, axis=1)
    w = T.words(piece)
    number = np.maximum(np.diff(w.at), 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.at[:-1][w.at[:-1] < len(same)]] = False
    out[:, TERMS - 1] = length * T.per_doc(same, w.at) / number
    out[:, TERMS - 2] = length * np.minimum(T.per_doc(_SIGN[x], piece.at) / number, 1)
    return out


@dataclass
class Model:
    weights: np.ndarray  # TERMS x RANK: inverse document frequency and decomposition
    vectors: np.ndarray  # labelled x RANK, of length 1
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(counts, axis=1, keepdims=True)
        out = (counts / np.maximum(length, 1e-12)) @ self.weights
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        prior = self.labels.mean()
        near = self.latent(counts) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= least - 1e-6, np.maximum(near, 0) ** SHARPNESS, 0)
        total = weight.sum(1)
        return np.where(total > 1e-9, np.clip((weight @ self.labels) / np.maximum(total, 1e-9), 0, 1), prior)


def train(counts: np.ndarray, labels: np.ndarray, *, rank: int = RANK, seed: int = 3) -> Model:
    """Randomised truncated decomposition of the weighted counts, with power steps."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    rows = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12) * idf
    random = np.random.Generator(np.random.PCG64(seed))
    rank = min(rank, *rows.shape)
    basis = np.linalg.qr(rows @ random.normal(size=(rows.shape[1], min(rank + 12, rows.shape[1]))).astype(np.float32))[0]
    for _ in range(2):
        basis = np.linalg.qr(rows @ np.linalg.qr(rows.T @ basis)[0])[0]
    _, _, right = np.linalg.svd(basis.T @ rows, full_matrices=False)
    model = Model((idf[:, None] * right[:rank].T).astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float32))
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 5000) -> Model | None:
    """A model from at most ``sample`` labelled documents that are not held out."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch.column("text")):
                rows = [x.tobytes() for x in term_counts(piece)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(piece.lo, piece.docs) for c in ("doc_id", "quality")] + [pa.array(rows, pa.binary())], ["doc_id", "quality", "counts"])

    kinds = dict(docs.dtypes)["doc_id"], dict(labels.dtypes)["quality"]
    counted = texts.mapInArrow(run, f"doc_id {kinds[0]}, quality {kinds[1]}, counts binary")
    got = counted.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("counts").alias("counts")).collect()
    if not got:
        return None
    got.sort()
    return train(np.stack([np.frombuffer(r["counts"], np.float32) for r in got]), np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch.column("text"), 1_000_000):
                ids = batch.column("doc_id").slice(piece.lo, piece.docs)
                found = []
                if model is None:
                    found = [np.full(piece.docs, 0.5)]
                else:
                    counts = term_counts(piece)
                    found = [model.scores(counts[lo : lo + 256]) for lo in range(0, piece.docs, 256)]
                value = np.concatenate(found).astype(float)
                yield pa.RecordBatch.from_arrays([ids, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
