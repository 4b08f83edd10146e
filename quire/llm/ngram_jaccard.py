"""N-gram Jaccard join by rare-first prefix filtering, and its components (operator 10).

A document's set holds the hashes of its distinct word n-grams. Two sets link when their
Jaccard similarity reaches a ratio num/den, compared exactly in integers.

1. Counts: batches of documents send the distinct n-grams of their sets to buckets by hash, with the
   number of sets that hold each, and get the totals of all batches back (``_exchange``). An n-gram is one entry
   per batch, so none is hot. Documents of equal sets are a class, and its smallest doc_id stands for it:
   a batch sends no more than one set of a class.
2. The order is rare-first by these exact counts, hashes break ties. Prefixes are COMMON - 1 n-grams
   longer than one common n-gram asks for, so sets that reach the ratio share COMMON of them (or as
   many as small sets allow). N-grams that one set holds meet nothing and need no row, and a
   document left with fewer n-grams than any link needs has none: most documents that are
   like no other end here, before any join.
3. Prefix rows are (n-gram, doc, size, position); those of class representatives stay, and again only n-grams in two
   prefixes or more and documents with enough of them.
4. Copies with small edits form large groups that share many n-grams. The first round pairs
   each row with two delegates of its n-gram only, the document whose prefix others share most
   and another by hash, and connects what links. Rows stay whose n-gram joins documents that
   are not connected. For documents that share n-grams with others not connected to them, n-grams that no other
   of these has are counted, as an overlap of two of them can hold none. The second round joins the rows of one
   n-gram and two components, so a group that is connected makes no pairs, an edited copy too
   far from all others of its group makes none with them, and every pair that could still
   connect components is tried.
5. A pair passes the length and positional filters, and is verified once against whole sets, after a
   suffix filter that bounds the overlap by how probes split both sets.

So the components are those of all links, although links inside a component that is already
known need not be tried. :func:`links` tries them all and gives each link itself.

Defined results: without words or text a document has no shingles, is linked with nothing
and is its own component; fewer than n words are one shingle; doc_id is a whole number; rows that repeat a doc_id are
one node of the graph; a row without doc_id links with nothing and has a null component; documents whose similarity is
the ratio itself link; an empty table gives no rows; columns other than doc_id and text are ignored; a long text is a set
in memory, of some hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from . import _text as T
from ._graph import components
from ._store import dropped, written

#: Common n-grams in the prefixes of sets that link.
COMMON = 8


def sets_of(piece: T.Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle hashes of each document, ascending, and the documents' bounds."""
    return _distinct_sets(*_shingles(T.words(piece, lower=True), n))


def _distinct_sets(keys: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    every = T.distinct(keys)
    owner = (every >> T.KEY_BITS).astype(np.int64)
    return every & np.uint64((1 << 52) - 1), np.searchsorted(owner, np.arange(docs + 1))


def _shingles(w: T.Words, n: int) -> tuple[np.ndarray, int]:
    """Document and hash of each shingle as one key, in the order of the words; those of few words last."""
    gram, whole = T.grams(w, n)
    doc = T.doc_of(w.at)
    at = np.flatnonzero(whole)
    keys = [T.keyed(doc[at], gram[at])]
    size = np.diff(w.at)
    for few in range(1, n):  # the whole sequence is one shingle
        some = np.flatnonzero(size == few)
        if len(some):
            total = np.full(len(some), few, np.uint64)
            for k in range(few):
                total = T.mix(total + w.hash[w.at[some] + k])
            keys.append(T.keyed(some, total))
    return np.concatenate(keys), len(w.at) - 1


def _signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(T.mix(values * np.uint64(2) + np.uint64(salt)), out=sums[1:])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


MEASURED = "doc_id long, n long, s1 long, s2 long, values binary, gram long, pos int"
_MEASURED = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "s1", "s2")), ("values", pa.binary()), ("gram", pa.int64()), ("pos", pa.int32())])


class _Sets:
    """The sets of a batch: of each row its size and signature, and the sets of those that may stand for a class."""

    def __init__(self, table: pa.Table, n: int):
        ids = table.column("doc_id")
        self.values, sizes, s1, s2 = [], [], [], []
        for piece in T.pieces(table.column("text")):
            values, at = sets_of(piece, n)
            one, two = _signatures(values, at)
            sizes.append(np.diff(at))
            s1.append(one)
            s2.append(two)
            self.values += [values[at[k] : at[k + 1]] for k in range(piece.docs)]
        none = np.zeros(0, np.int64)
        self.n, self.s1, self.s2 = (np.concatenate(c) if c else none for c in (sizes, s1, s2))
        known: dict[tuple, tuple] = {}  # of equal sets, the row of the smallest doc_id
        for k, (doc, key) in enumerate(zip(ids.to_pylist(), zip(self.n.tolist(), self.s1.tolist(), self.s2.tolist(), strict=True), strict=True)):
            if doc is not None and key[0] and (key not in known or doc < known[key][0]):
                known[key] = (doc, k)
        self.rows = np.array(sorted(k for _, k in known.values()), np.int64)
        whole = np.concatenate([self.values[k] for k in self.rows]) if len(self.rows) else np.zeros(0, np.uint64)
        self.size = self.n[self.rows]
        self.distinct, self.place, self.count = np.unique(whole, return_inverse=True, return_counts=True)
        self.whole = whole


def _measured(docs: DataFrame, n: int, ratio: tuple[int, int], batch_bytes: int, bucket_bytes: int) -> DataFrame:
    """A row for each document (gram null), with the whole set of those that have rows for n-grams of their prefix."""
    num, den = ratio
    buckets = X.Buckets(X.text_bytes(docs), batch_bytes, bucket_bytes)
    spare = np.uint64(64 - 52)

    def send(table: pa.Table) -> list[tuple[int, bytes]]:
        found = _Sets(table, n)
        kept, count = buckets.kept_of(found.distinct << spare), found.count.astype("<u4")
        return [(k, X.packed(X.deltas(kept[lo:hi]), count[lo:hi])) for k, lo, hi in buckets.parts(kept)]

    def take(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        found, ids = _Sets(table, n), table.column("doc_id").combine_chunks()
        total = np.zeros(len(found.distinct), np.int64)
        for k, lo, hi in buckets.parts(buckets.kept_of(found.distinct << spare)):
            total[lo:hi] = X.unpacked(answers[k], "<u4")[0]
        at = np.append(0, np.cumsum(found.size))
        doc, rank = T.doc_of(at), total[found.place]
        order = np.lexsort((found.whole, rank, doc))
        least = -(-num * found.size // den)  # ceil(size * ratio), the overlap that a link needs
        length = found.size - least + np.minimum(least, COMMON)
        place = np.arange(len(doc)) - at[:-1][doc]
        use = (place < length[doc]) & (rank[order] > 1)
        # A partner has at least the ratio of this size, and the smaller of two sets may share fewer than COMMON.
        enough = T.per_doc(use, at) >= np.minimum(COMMON, -(-num * least // den))
        use &= enough[doc]
        values = [None] * len(ids)
        for k in found.rows[enough].tolist():
            values[k] = found.values[k].astype("<u8").tobytes()
        own = {"doc_id": ids, "n": pa.array(found.n, pa.int64()), "s1": pa.array(found.s1, pa.int64()), "s2": pa.array(found.s2, pa.int64()), "values": pa.array(values, pa.binary())}
        rows = found.rows[doc[use]]
        prefix = {"doc_id": ids.take(pa.array(rows)), "n": pa.array(found.n[rows], pa.int64()), "gram": pa.array(found.whole[order][use].view(np.int64)), "pos": pa.array(place[use].astype(np.int32))}
        tables = [pa.Table.from_arrays([part[f.name].cast(f.type) if f.name in part else pa.nulls(len(part["n"]), f.type) for f in _MEASURED], schema=_MEASURED) for part in (own, prefix)]
        return pa.concat_tables(tables)

    return X.round_trip(docs, buckets, send, X.totals, take, MEASURED)


def _may_link(num: int, den: int) -> Column:
    """Length and positional filters for a row pair (n, pos and n2, pos2) of one n-gram."""
    n, n2, pos, pos2 = (F.col(c).cast("long") for c in ("n", "n2", "pos", "pos2"))
    length = (F.least(n, n2) * den) >= (F.greatest(n, n2) * num)
    most = F.least(pos, pos2) + 1 + F.least(n - pos - 1, n2 - pos2 - 1)
    return length & (most * (num + den) >= (n + n2) * num)  # |A & B| >= (|A| + |B|) num / (num + den)


def _suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """At most so many elements are common: probes from the middle of b split both, a few times."""
    if not len(a) or not len(b):
        return 0
    if not depth:
        return min(len(a), len(b))
    probe = len(b) // 2
    split = int(np.searchsorted(a, b[probe]))
    here = int(split < len(a) and a[split] == b[probe])
    return here + _suffix_bound(a[:split], b[:probe], depth - 1) + _suffix_bound(a[split + here :], b[probe + 1 :], depth - 1)


def reaches(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets have a Jaccard similarity of num/den or more."""
    need = -(-num * (len(a) + len(b)) // (num + den))
    if _suffix_bound(a, b, 2) < need:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    num, den = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("one", "two"))
            good = [reaches(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), num, den) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_one = pairs.join(sets.select(F.col("doc").alias("a"), F.col("values").alias("one")), "a")
    with_two = with_one.join(sets.select(F.col("doc").alias("b"), F.col("values").alias("two")), "b")
    return with_two.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _candidates(measured: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (n, s1, s2, rep), and prefix rows (doc, n, gram, pos) of their representatives that may meet a partner."""
    classes = written(measured.where("gram IS NULL AND n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes", few_files=True)
    prefixes = measured.where("gram IS NOT NULL").select(F.col("doc_id").alias("doc"), "n", "gram", "pos")
    every = written(prefixes.join(classes.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi"), "prefixes", few_files=True)
    twice = every.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    some = written(every.join(twice, "gram", "left_semi"), "shared", few_files=True)
    needed = F.least(F.lit(COMMON), F.ceil(F.ceil(F.col("n") * num / den) * num / den))
    enough = some.groupBy("doc", "n").agg(F.count("*").alias("k")).where(F.col("k") >= needed).select("doc")
    rows = written(some.join(enough, "doc", "left_semi"), "rows", few_files=True)
    dropped(every, some)
    return classes, rows


def _sets(measured: DataFrame) -> DataFrame:
    return measured.where("values IS NOT NULL").select(F.col("doc_id").alias("doc"), "values")


def joined(docs: DataFrame, *, n: int = 4, ratio: tuple[int, int] = (85, 100), batch_bytes: int = X.BATCH_BYTES, bucket_bytes: int = X.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id of an equal set) for each row of docs."""
    num, den = ratio
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = written(_measured(docs, n, ratio, batch_bytes, bucket_bytes), "measured")
    classes, rows = _candidates(measured, num, den)
    sets = _sets(measured)

    # How much of its prefix a document shares: copies hold n-grams of their own edits, and what they are copies of holds none.
    share = rows.groupBy("doc", "n").agg(F.count("*").alias("k")).select("doc", (F.col("k") / (F.col("n") - F.ceil(F.col("n") * num / den) + COMMON)).alias("share"))
    member = [F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos")]
    picks = rows.join(share, "doc").groupBy("gram").agg(F.min(F.struct((-F.col("share")).alias("h"), *member)).alias("one"), F.min(F.struct(F.xxhash64("doc").cast("double").alias("h"), *member)).alias("two"))
    near = rows.join(picks, "gram").select("doc", "n", "pos", F.inline(F.array_distinct(F.array("one", "two"))))
    tried = written(_pairs(near, num, den), "pairs", few_files=True)
    links = written(_verified(tried, sets, ratio), "links")

    labels = components(links).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    named = written(rows.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")), "named", few_files=True)
    parts = named.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
    crowd = written(named.join(parts, "gram", "left_semi"), "open", few_files=True)
    sizes = _shared_sizes(sets.join(crowd.select("doc").distinct(), "doc", "left_semi"))
    # A document stays if what others of these hold of it is enough for a link with a set of its own size or smaller.
    likely = sizes.where(F.col("most") * (num + den) >= F.ceil(F.col("n") * (num + den) * num / den)).drop("n")
    left = written(crowd.join(likely, "doc"), "open", few_files=True)
    right = left.select("gram", *(F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos", "label", "most")))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"), "most", "most2")
    fits = most * (num + den) >= (F.col("n") + F.col("n2")).cast("long") * num
    across = left.join(right, "gram").where((F.col("label") < F.col("label2")) & fits)
    rest = written(_pairs(across, num, den).join(tried, ["a", "b"], "left_anti"), "pairs", few_files=True)
    found = components(links.union(written(_verified(rest, sets, ratio), "links")))

    own = measured.where("gram IS NULL").select("doc_id", "n", "s1", "s2")
    reps = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = own.join(reps, ["n", "s1", "s2"], "left")
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    result = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id")), "joined", few_files=True)
    dropped(measured, classes, rows, tried, links, named, crowd, left, rest)
    return result


def links(docs: DataFrame, *, n: int = 4, ratio: tuple[int, int] = (85, 100), batch_bytes: int = X.BATCH_BYTES, bucket_bytes: int = X.BUCKET_BYTES) -> DataFrame:
    """(a, b): every link of two classes of equal sets, by their smallest doc_ids, a < b.

    All pairs within a component are tried, so a large group of edited copies takes as many rows as it has pairs.
    With the class_id of :func:`joined`, these are the links of all documents; those of one class link too.
    """
    num, den = ratio
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = written(_measured(docs, n, ratio, batch_bytes, bucket_bytes), "measured")
    _, rows = _candidates(measured, num, den)
    other = rows.select("gram", *(F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos")))
    tried = written(_pairs(rows.join(other, "gram").where("doc < doc2"), num, den), "pairs", few_files=True)
    return _verified(tried, _sets(measured), ratio).distinct()


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(doc, n, most): of a set's n n-grams, how many some other of these sets has too."""
    sets = written(sets, "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                raw = batch.column("values").slice(lo, 256).to_pylist()
                doc = batch.column("doc").slice(lo, 256).take(pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.frombuffer(b"".join(raw), "<i8"))], ["doc", "gram"])

    grams = sets.mapInArrow(run, "doc long, gram long")
    alone = grams.groupBy("gram").agg(F.count("*").alias("k"), F.min("doc").alias("doc")).where("k = 1").groupBy("doc").agg(F.count("*").alias("alone"))
    return sets.select("doc", (F.octet_length("values") / 8).cast("long").alias("n")).join(alone, "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))


def _pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs a < b of row pairs that pass the filters."""
    return rows.where((F.col("doc") != F.col("doc2")) & _may_link(num, den)).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()
