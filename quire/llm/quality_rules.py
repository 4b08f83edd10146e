"""Quality rules: learned decision lists over counts of a text (operator 3).

Sequential covering in the manner of incremental reduced-error pruning. The examples are
split into a growing and a pruning part. A rule is grown as a conjunction of thresholds, each
chosen by information gain, then conditions are dropped from its end while that raises its
worth on the pruning part. Rules that reject with enough precision join the list, what they
cover leaves the examples, and learning ends when no such rule is found. The list becomes
one ordered Spark CASE expression that names the rule that fires.

Statistics come from one pass over whole texts (:func:`text_stats`). Learning uses a bounded
sample of labelled documents (``sample``, chosen by a hash of doc_id); every document is
then judged. Defined results: a null or empty text has zero counts, so the fixed base rule
rejects it; repeated rows are judged alike, and a doc_id that repeats among sampled ones teaches once; equal hashes are taken by doc_id;
without labels of both classes no rule is learned and only the base rule rejects; an empty table gives no rows; a long text is
measured whole, in memory; other columns of the input are ignored, and :func:`kept` returns them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_short_words", "n_lines")
WINDOW = 8


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _table("!?")
_DIGIT = _table("0123456789")


def _repeated_words(w: T.Words, docs: int) -> np.ndarray:
    """Words inside windows of WINDOW words that a text has twice or more."""
    gram, whole = T.grams(w, WINDOW)
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(docs, np.int64)
    key = T.keyed(T.doc_of(w.at)[at], gram[at])
    ordered = np.sort(key)
    twice = T.distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(docs, np.int64)
    place = np.searchsorted(twice, key)
    hit = at[twice[np.minimum(place, len(twice) - 1)] == key]
    change = np.zeros(len(w.hash) + WINDOW + 1, np.int32)
    change[hit] += 1
    change[hit + WINDOW] -= 1
    return T.per_doc(np.cumsum(change)[: len(w.hash)] > 0, w.at)


def _repeated_lines(piece: T.Piece, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and those with a word that equal an earlier line of the text."""
    begin, end = T.runs(piece.data != 10, piece.at)  # an empty line has no word
    filled = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    worded = filled[end] > filled[begin]
    begin, end = begin[worded], end[worded]
    at = np.searchsorted(begin, piece.at)
    keys = T.distinct(T.keyed(T.doc_of(at), T.Hashes(piece.data).of(begin, end)))
    kept = np.bincount((keys >> T.KEY_BITS).astype(np.int64), minlength=piece.docs)
    return np.diff(at), np.diff(at) - kept


def piece_stats(piece: T.Piece) -> list[np.ndarray]:
    data, w = piece.data, T.words(piece)
    solid = ~T.SEPARATOR[data]
    lines, repeated = _repeated_lines(piece, solid)
    return [
        np.diff(w.at),
        T.per_doc(solid & ((data & 0xC0) != 0x80), piece.at),
        T.per_doc(_SYMBOL[data], piece.at),
        repeated,
        _repeated_words(w, piece.docs),
        T.per_doc(_UPPER[data], piece.at),
        T.per_doc(_MARK[data], piece.at),
        T.per_doc(_DIGIT[data], piece.at),
        T.per_doc((w.end - w.begin) <= 2, w.at),
        lines,
    ]


def text_stats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The COUNTS of each whole text after the columns to carry, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch.column("text")):
                own = [batch.column(c).slice(piece.lo, piece.docs) for c in carry]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in piece_stats(piece))], [*carry, *COUNTS])

    schema = docs.select(*carry).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, schema)


#: What rules may test: ratios, so that a rule means the same for short and long texts.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "short_ratio": ("n_short_words", "n_words"),
    "line_ratio": ("n_lines", "n_words"),
}


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias(name) for name, (a, b) in FEATURES.items()))


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self) -> Column:
        x = F.col(self.feature)
        return x >= F.lit(self.threshold) if self.at_least else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covered(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(rows)
    return out


def _best_test(rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the most information gain for the bad rows, over all features."""
    best, found = 1e-9, None
    p, n = bad.sum(), len(bad) - bad.sum()
    if not p:
        return 0.0, None
    before = np.log2(p / (p + n))
    for name, x in rows.items():
        order = np.argsort(x, kind="stable")
        v, hits = x[order], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])  # after these places the value changes
        if not len(cut):
            continue
        mid = (v[cut] + v[cut + 1]) / 2
        for at_least in (False, True):
            pos = (p - hits[cut]) if at_least else hits[cut]
            size = (len(v) - cut - 1) if at_least else cut + 1
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / size) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Test(name, at_least, float(mid[k]))
    return best, found


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 4, most_tests: int = 4, most_rules: int = 32, seed: int = 7) -> list[Rule]:
    """An ordered list of rules, each a conjunction, that together cover the bad rows.

    precision: a rule must have it on the growing and pruning parts together, as rejecting
    good documents costs more than keeping bad ones. least: bad rows that a rule must cover.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    random = np.random.Generator(np.random.PCG64(seed))
    while len(rules) < most_rules and bad[left].sum() >= least:
        left = random.permutation(left)
        cut = len(left) * 2 // 3
        grow, prune = left[:cut], left[cut:]
        rule: Rule = ()
        inside = grow
        while len(rule) < most_tests and 0 < bad[inside].sum() < len(inside):
            _, test = _best_test({k: v[inside] for k, v in rows.items()}, bad[inside])
            if test is None:
                break
            rule += (test,)
            inside = inside[test.holds({k: v[inside] for k, v in rows.items()})]
        worth = []
        for size in range(1, len(rule) + 1):
            on = _covered(rule[:size], {k: v[prune] for k, v in rows.items()}, len(prune))
            p, n = bad[prune][on].sum(), (~bad[prune])[on].sum()
            worth.append((p - n) / (p + n) if p + n else -1.0)
        if not worth:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        on = left[_covered(rule, {k: v[left] for k, v in rows.items()}, len(left))]
        if bad[on].sum() < least or bad[on].mean() < precision:
            break
        rules.append(rule)
        left = np.setdiff1d(left, on)
    return rules


def rule_name(rules: list[Rule]) -> Column:
    """The first rule that fires, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        on = rule[0].column()
        for test in rule[1:]:
            on &= test.column()
        out = F.when(on, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learned_rules(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, **options) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents, those of the lowest hash of doc_id.

    The ids of the sample, a bounded set, are broadcast, so only their texts are measured.
    Documents that the base rule rejects teach nothing and are left out.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    one = with_features(text_stats(texts)).where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("found"))
    rows = one.join(F.broadcast(chosen), "doc_id").select("quality", "found.*").toPandas().sort_values(["quality", *FEATURES])
    bad = (rows["quality"] == 0).to_numpy()
    return learn({name: rows[name].to_numpy(float) for name in FEATURES}, bad, **options) if 0 < bad.sum() < len(bad) else []


def judge(docs: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each document after the columns to carry, base_failed, the rule that rejects it, and kept."""
    out = with_features(text_stats(docs, carry)).withColumn("base_failed", base_failed()).withColumn("rule", rule_name(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the base rule and the rules keep, with all columns of docs."""
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(rest))).alias("row"), "text")
    found = judge(row, rules, ("row", "text")).where("kept")
    return found.select(*("text" if c == "text" else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns))


def rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents with their verdict, by rules learned from the labels."""
    return judge(docs, learned_rules(docs, labels, **options))
