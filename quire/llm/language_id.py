"""Language by a byte convolutional network in numpy (operator 2).

Bytes have a learned embedding; filters of widths WIDTHS run over them, each filter keeps its
maximum over a window of LENGTH bytes, and a softmax layer turns the maxima into languages. A
text is cut into windows of fixed length, the last one padded with zeros; a window's filters
see up to three bytes of the window after it. A document's score is the mean of its windows'
probabilities, weighted by their bytes, so whole texts count.

As the embedding and the filters are linear, what a filter gives for a pair of bytes at one
place is a look-up in a table of all pairs; four bytes take two look-ups.

Training uses a bounded sample of every language: at most ``sample`` documents in all, as evenly
over the languages as they allow, or EACH of a language where these are more; two windows of each, from any place of its text. Held-out rows, and rows without doc_id, text
or language, teach nothing. Defined results: a text that is null or has no letter is ``und``
with score 0; repeated rows are judged alike; without any row to learn from, all are ``und``;
of equal probabilities the first language by name is taken; an empty table gives no rows; doc_id is a whole number; a long text is
windowed whole, piece by piece; only text is an input of a prediction, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
UNKNOWN = "und"
#: Documents of each language to learn from, however many languages there are.
EACH = 32


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # 4 x EMBEDDING x all filters; places beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the filters give for each pair of bytes, in their first two and last two places."""
        one = [self.embedding @ self.filters[k] for k in range(4)]
        pairs = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) for k in (0, 2)]
        return pairs[0].astype(np.float32), pairs[1][:, FILTERS:].astype(np.float32)


def _mask() -> np.ndarray:
    width = np.repeat(WIDTHS, FILTERS)
    return (np.arange(4)[:, None] < width[None, :]).astype(np.float32)[:, None, :]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], *, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on cross entropy. windows: n x (LENGTH + 3) bytes; target: indices into languages."""
    random = np.random.Generator(np.random.PCG64(seed))
    total = FILTERS * len(WIDTHS)
    mask = _mask()
    p = {
        "embedding": random.normal(0, 0.5, (256, EMBEDDING)),
        "filters": random.normal(0, 0.3, (4, EMBEDDING, total)) * mask,
        "bias": np.zeros(total),
        "out": random.normal(0, 0.3, (total, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n, x = len(rows), windows[rows]
            seen = p["embedding"][x]  # n x (LENGTH+3) x EMBEDDING
            value = sum(seen[:, k : k + LENGTH] @ p["filters"][k] for k in range(4))
            top = value.argmax(1)  # n x filters
            pooled = np.take_along_axis(value, top[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ p["out"] + p["out_bias"])
            error[np.arange(n), target[rows]] -= 1
            error /= n
            back = (error @ p["out"].T) * (pooled > 0)
            g = {"out": hidden.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "filters": np.zeros_like(p["filters"]), "embedding": np.zeros_like(p["embedding"])}
            own = np.arange(n)[:, None]
            for k in range(4):
                bytes_ = x[own, top + k]  # n x filters
                g["filters"][k] = np.einsum("nfe,nf->ef", p["embedding"][bytes_], back)
                np.add.at(g["embedding"], bytes_, back[:, :, None] * p["filters"][k].T[None])
            g["filters"] *= mask
            step += 1
            for k, v in p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, **p)


def as_windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a piece as rows of LENGTH + 3 bytes, the first row of each text, and its own bytes in each row.

    Zeros follow each text, so nothing of its neighbours is seen.
    """
    size = np.diff(at)
    number = np.maximum(-(-size // LENGTH), 1)
    start = np.append(0, np.cumsum(number))
    room = number * LENGTH + 3
    place = np.append(0, np.cumsum(room))
    flat = np.zeros(place[-1], np.uint8)
    flat[np.arange(len(data)) + np.repeat(place[:-1] - at[:-1], size)] = data
    inside = np.arange(start[-1]) - np.repeat(start[:-1], number)
    rows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH + 3)[np.repeat(place[:-1], number) + inside * LENGTH]
    return rows, start, np.clip(np.repeat(size, number) - inside * LENGTH, 0, LENGTH)


class Scorer:
    def __init__(self, model: Model):
        self.model, (self.front, self.rear) = model, model.tables()

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of windows, a few at a time."""
        m, out = self.model, []
        for lo in range(0, len(rows), 128):
            x = rows[lo : lo + 128].astype(np.int32)
            pair = (x[:, :-1] << 8) | x[:, 1:]
            value = np.take(self.front, pair[:, :LENGTH], axis=0)
            value[:, :, FILTERS:] += np.take(self.rear, pair[:, 2:], axis=0)
            hidden = np.maximum(value.max(1) + m.bias, 0)
            out.append(_softmax(hidden @ m.out + m.out_bias))
        return np.concatenate(out)

    def texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of each text of a piece."""
        rows, start, weight = as_windows(data, at)
        p = self.windows(rows) * weight[:, None]
        total = np.maximum(np.add.reduceat(weight, start[:-1]), 1)
        return np.add.reduceat(p, start[:-1], axis=0) / total[:, None]


def held_out(of: int = 4, rest: int = 2) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(False))


def fit(docs: DataFrame, *, sample: int = 6000) -> Model | None:
    """A network of all languages, from at most ``sample`` rows, or EACH of a language if these are more."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    sizes = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not sizes:
        return None
    # A hash bound for each language that lets about an equal number of its rows through.
    each = max(sample // len(sizes), EACH)
    bounds = docs.sparkSession.createDataFrame([(name, min(1.0, 1.2 * each / n)) for name, n in sizes], "lang string, bound double")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Of each text two windows, from hashed places anywhere in it; only they are sorted and sent.
    room = F.greatest(F.length("text") - LENGTH, F.lit(1))
    window = [F.col("text").substr(F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1, F.lit(LENGTH + 3)).alias(name) for k, name in enumerate("ab")]
    rows = rows.select("doc_id", "lang", *window)
    picked = rows.join(F.broadcast(bounds), "lang").where(share < F.col("bound")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each)
    got = picked.select("lang", "a", "b").collect()
    languages = sorted(name for name, _ in sizes)
    number = {name: k for k, name in enumerate(languages)}
    raw = [(x.encode()[: LENGTH + 3], number[r["lang"]]) for r in sorted(got) for x in (r["a"], r["b"])]
    windows = np.zeros((len(raw), LENGTH + 3), np.uint8)
    for k, (x, _) in enumerate(raw):
        windows[k, : len(x)] = np.frombuffer(x, np.uint8)
    return train(windows, np.array([y for _, y in raw]), languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            for piece in T.pieces(batch.column("text")):
                ids = batch.column("doc_id").slice(piece.lo, piece.docs)
                known = batch.column("has_letter").slice(piece.lo, piece.docs).to_numpy(zero_copy_only=False)
                if scorer is None:
                    name, score = np.full(piece.docs, UNKNOWN, object), np.zeros(piece.docs)
                else:
                    p = scorer.texts(piece.data, piece.at)
                    best = p.argmax(1)
                    name = np.where(known, np.array(scorer.model.languages, object)[best], UNKNOWN)
                    score = np.where(known, np.minimum(p[np.arange(len(p)), best], 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(score.astype(float))], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
