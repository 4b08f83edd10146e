"""Cases that hold for every operator, and brute force where several batches, large groups or edits matter."""

from __future__ import annotations

import collections
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language_id, lm_scores, mixing, ngram_jaccard, packing, passages, quality_rules, quality_votes, tiff, token_ids
from tests.llm.test_operators import WORD, components_by_hand, counts_by_hand, covered, path, sets_by_hand, word_table

SMALL = {"batch_bytes": 2000, "bucket_bytes": 1000}
#: Names that operators use for columns of their own.
CLASHING = ("quality", "n_words", "kept", "rule", "topic", "n_tokens", "probability", "spans", "row", "batch", "bucket", "text_hash", "gram", "label", "score")


# ---- near copies: many batches, large groups ----


def test_jaccard_over_many_batches_and_a_large_group(spark):
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = {}
    for size, copies in ((120, 150), (60, 90), (200, 3), (40, 40)):  # copies with several edits: some link, some are too far
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            edits = set(rng.sample(range(size), rng.choice([0, 0, 1, 2, 4, 8])))
            texts[len(texts)] = " ".join(rng.choice(vocabulary) if j in edits else w for j, w in enumerate(base))
    for _ in range(100):
        texts[len(texts)] = " ".join(rng.choices(vocabulary, k=rng.randint(3, 90)))
    sets = sets_by_hand(texts, 4)
    want = components_by_hand(sets, 85, 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.joined(docs, **SMALL).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in texts}
    assert max(collections.Counter(want.values()).values()) > 64
    whole = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.joined(docs).collect()}
    assert whole == want


# ---- passages ----


def near_windows(docs, least=50, agree=40):
    """(doc_id, place) of all words in windows of ``least`` words of which an earlier document's window has ``agree`` or more in place.

    With at most ten others among fifty, four agreeing words lie in a row somewhere, so diagonals without four in a row need no look.
    """
    keys = sorted(docs)
    number: dict[str, int] = {}
    coded = {k: np.array([number.setdefault(w, len(number)) for w in docs[k]], np.int64) for k in keys}
    at: dict[tuple, list] = collections.defaultdict(list)
    out = set()
    for k in keys:
        w = docs[k]
        diagonals = {(j, q - p) for p in range(len(w) - 3) for j, q in at[tuple(w[p : p + 4])]}
        for j, shift in diagonals:
            a, b = coded[k], coded[j]
            lo, hi = max(0, -shift), min(len(a), len(b) - shift)
            if hi - lo >= least:
                total = np.append(0, np.cumsum(a[lo:hi] == b[lo + shift : hi + shift]))
                for p in np.flatnonzero(total[least:] - total[:-least] >= agree).tolist():
                    out |= {(k, lo + p + i) for i in range(least)}
        for p in range(len(w) - 3):
            at[tuple(w[p : p + 4])].append((k, p))
    return out


def test_passages_against_all_windows(spark, texts):
    docs = {k: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for k, t in texts.items()}
    want = near_windows(docs)
    for options in ({}, SMALL):
        found = covered(passages.passages(word_table(spark, docs), **options).collect())
        assert len(want & found) >= 0.95 * len(want) > 0


def test_passages_whose_pieces_are_everywhere(spark):
    rng = random.Random(33)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(80)]
    edited = [word() if k % 20 == 7 else w for k, w in enumerate(passage)]
    docs = {k: [word() for _ in range(20)] + passage[8 * k : 8 * k + 16] + [word() for _ in range(20)] for k in range(10)}
    docs[50], docs[60], docs[70] = passage + [word() for _ in range(9)], [word() for _ in range(9)] + passage, edited
    for options in ({}, SMALL):
        found = covered(passages.passages(word_table(spark, docs), **options).collect())
        assert {(60, 9 + j) for j in range(80)} <= found and len({(70, j) for j in range(80)} & found) >= 60
        assert {k for k, _ in found} == {60, 70}


def test_passages_of_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(34)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    a, b, c = ([word() for _ in range(120)] for _ in range(3))
    rows = [(1, " ".join(a)), (2, " ".join(a[20:100] + b[:40])), (2, " ".join(c)), (2, " ".join(c)), (None, " ".join(a))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passages(table)
    assert {(r["doc_id"], r["start"], r["end"], r["ref_doc_id"]) for r in found.collect()} == {(2, 0, 80, 1)}
    left = sorted(r["text"] for r in passages.cut(table, found).collect())
    assert left == sorted([" ".join(a), " ".join(b[:40]), " ".join(c), " ".join(c), " ".join(a)])


def test_passages_within_a_document(spark):
    rng = random.Random(35)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    part, line = [word() for _ in range(60)], [word() for _ in range(10)]
    docs = {1: part + [word() for _ in range(30)] + part, 2: line * 20, 3: [word() for _ in range(100)]}
    table = word_table(spark, docs)
    assert passages.passages(table).count() == 0
    found = covered(passages.passages(table, within=True).collect())
    assert {k for k in found if k[0] == 1} == {(1, j) for j in range(90, 150)}
    assert {k for k in found if k[0] == 2} == {(2, j) for j in range(50, 200)} and not any(k == 3 for k, _ in found)


# ---- TIFF ----


def directory(fields, data=b""):
    out = bytearray(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(fields)))
    for tag, value in sorted(fields.items()):
        out += struct.pack("<HHII", tag, 4, 1, value)
    return bytes(out + b"\0" * 4)


def test_tiff_bad_claims_are_rows_with_an_error(spark):
    good = {tiff.IMAGE_WIDTH: 4, tiff.IMAGE_LENGTH: 2, tiff.BITS_PER_SAMPLE: 8, tiff.STRIP_OFFSETS: 8, tiff.STRIP_BYTE_COUNTS: 8, tiff.ROWS_PER_STRIP: 2}
    tiles = {tiff.IMAGE_WIDTH: 4, tiff.IMAGE_LENGTH: 2, tiff.BITS_PER_SAMPLE: 8, tiff.TILE_OFFSETS: 8, tiff.TILE_BYTE_COUNTS: 8, tiff.TILE_WIDTH: 4, tiff.TILE_LENGTH: 2}
    bad = [good | {tiff.ROWS_PER_STRIP: 0}, good | {tiff.IMAGE_WIDTH: 2**31, tiff.IMAGE_LENGTH: 2**31}, good | {tiff.IMAGE_LENGTH: 0}, good | {tiff.SAMPLES_PER_PIXEL: 0}, tiles | {tiff.TILE_WIDTH: 0}, tiles | {tiff.TILE_LENGTH: 2**32 - 1}, good | {tiff.STRIP_OFFSETS: 2**32 - 1}, good | {tiff.COMPRESSION: 99}]
    files = [(k, directory(f, b"abcdefgh")) for k, f in enumerate([good, tiles, *bad])] + [(90, None), (91, b"")]
    table = spark.createDataFrame(files, "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in tiff.read_pages(table, key="doc_id", media="media").collect()}
    assert len(rows) == len(files) and bytes(rows[0]["samples"]) == bytes(rows[1]["samples"]) == b"abcdefgh"
    assert all(rows[k]["page"] is None and rows[k]["error"] for k in rows if k > 1)
    digests = {r["doc_id"]: r for r in tiff.digests(table.withColumn("n_bytes", F.lit(8).cast("long"))).collect()}
    assert len(digests) == len(files) and digests[0]["payload_bytes"] == 8 and all(digests[k]["payload_sha256"] is None for k in digests if k > 1)


def test_tiff_known_bytes():
    # LZW codes of 9 bits: clear, 7, 258 (7 7), 8, 8, 258, end: the example of the format's description, cut short
    codes, bits = [256, 7, 258, 8, 8, 258, 257], 0
    for c in codes:
        bits = bits << 9 | c
    raw = (bits << (-9 * len(codes)) % 8).to_bytes(-(-9 * len(codes) // 8), "big")
    assert tiff.lzw_unpack(raw, 7) == bytes([7, 7, 7, 8, 8, 7, 7])
    # two planes of 3 x 2 samples, each in a strip of its own, with differences
    data = bytes([1, 1, 1, 5, 0, 251]) + bytes([9, 0, 0, 7, 1, 1])
    fields = {tiff.IMAGE_WIDTH: 3, tiff.IMAGE_LENGTH: 2, tiff.BITS_PER_SAMPLE: 8, tiff.SAMPLES_PER_PIXEL: 2, tiff.PLANAR: 2, tiff.PREDICTOR: 2, tiff.ROWS_PER_STRIP: 2}
    raw = bytearray(b"II*\0" + struct.pack("<I", 8 + len(data) + 16) + data + struct.pack("<IIII", 8, 14, 6, 6) + struct.pack("<H", len(fields) + 2))
    for tag, value in sorted((fields | {tiff.STRIP_OFFSETS: 20, tiff.STRIP_BYTE_COUNTS: 28}).items()):
        raw += struct.pack("<HHII", tag, 4, 2 if tag in (tiff.STRIP_OFFSETS, tiff.STRIP_BYTE_COUNTS) else 1, value)
    (page,) = tiff.decode(bytes(raw + b"\0" * 4))
    assert page.channels == 2 and list(page.samples) == [1, 2, 3, 5, 5, 0, 9, 9, 9, 7, 8, 9]


# ---- files of ids, packing ----


def test_a_file_of_ids_is_read_by_itself(spark, odd_docs, tmp_path):
    name = path("word_bpe_49k.json")
    ids = token_ids.token_ids(odd_docs, name).persist()
    token_ids.write_file(ids, token_ids.code_lengths(token_ids.id_counts(ids)), f"file://{tmp_path}/ids", 1)
    got = collections.Counter((r["doc_id"], bytes(r["ids"])) for r in token_ids.read_file(spark.newSession(), f"file://{tmp_path}/ids").collect())
    want = collections.Counter((r["doc_id"], np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) for r in ids.collect())
    ids.unpersist()
    assert got == want


def test_plan_is_best_fit_decreasing():
    rng = random.Random(36)
    for _ in range(60):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        rooms: list[int] = []
        for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(64 - length)
        assert packing.plan(counts, 64)[1] == len(rooms)


# ---- mixing ----


def test_mixing_meets_given_targets(spark):
    rng = random.Random(37)
    rows = [(k, "w " * rng.randint(1, 30), rng.choice(["a", "a", "a", "b", None]), rng.choice(["en", "fr"]), rng.choice("xyz")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, theme string")
    targets = {"source": {"a": 0.2, "b": 0.5, None: 0.3}, "topic": {"x": 3, "y": 1}}
    found = mixing.mixed(docs, targets=targets, share=0.1, topic_column=F.col("theme")).toPandas()
    weight = found.n_tokens * found.probability
    share = lambda by: (weight.groupby(found[by].fillna("none")).sum() / weight.sum()).to_dict()
    assert share("source") == pytest.approx({"a": 0.2, "b": 0.5, "none": 0.3}, abs=1e-6)
    assert share("topic") == pytest.approx({"x": 0.75, "y": 0.25, "z": 0.0}, abs=1e-6)
    assert weight.sum() / found.n_tokens.sum() == pytest.approx(0.1, abs=1e-6)
    cells = docs.withColumn("topic", F.col("theme")).groupBy(*mixing.DIMENSIONS).agg(F.count("*").alias("tokens"))
    assert mixing.fitted(cells, mixing.EXPONENTS)[1] <= mixing.TOLERANCE


# ---- clashing columns, long texts, doc_ids as text ----


@pytest.fixture(scope="module")
def wide(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    rng = random.Random(38)
    long = " ".join(f"{rng.choice('abcdefg')}{rng.randrange(50_000)}" for _ in range(330_000))
    texts = {"1": base + "one two", "2": base + "one two", "3": long, "4": "short", "5": None, "6": long + " more", "7": base * 30}
    rows = [(int(k), t, "en", "s", *(f"{c}-{k}" for c in CLASHING)) for k, t in texts.items()]
    assert len(long) > 2_000_000
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).persist()


def test_columns_of_documents_stay_as_they_were(wide):
    want = {r["doc_id"]: r for r in wide.collect()}
    kept = quality_rules.kept(wide, [(quality_rules.Test("repeat_ratio", True, 0.9),)])
    assert kept.columns == wide.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 6}
    found = [*kept.collect(), *mixing.kept(wide, share=1.0).collect()]
    assert all(r == want[r["doc_id"]] for r in found)
    left = passages.cut(wide, passages.passages(wide))
    assert left.columns == wide.columns
    for r in left.collect():
        assert all(r[c] == want[r["doc_id"]][c] for c in wide.columns if c != "text") and (r["doc_id"] in (2, 6) or r["text"] == want[r["doc_id"]]["text"])


def test_long_texts_and_clashing_names_in_every_operator(spark, wide, labels):
    texts = {r["doc_id"]: r["text"] for r in wide.collect()}
    assert {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS[:5]) for r in quality_rules.text_stats(wide).collect()} == {k: counts_by_hand(t) for k, t in texts.items()}
    own = wide.select("doc_id").withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    model = quality_votes.fit(wide, own)
    assert quality_votes.score(wide, model).count() == 7 and quality_rules.rejected(wide, own).count() == 7
    assert {r["lang_pred"] for r in language_id.predict(wide, language_id.fit(wide)).collect()} == {"en", "und"}
    sha = {r["doc_id"]: r["payload_bytes"] for r in tiff.digests(tiff.texts_as_tiff(wide)).collect()}
    assert sha == {k: len(tiff.payload_of((t or "").encode())) for k, t in texts.items()}
    n = {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_words"] for r in lm_scores.scores(wide, batch_bytes=100_000).collect()} == n
    joined = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.joined(wide, batch_bytes=100_000, bucket_bytes=50_000).collect()}
    assert joined == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3, 7: 7}
    found = {(r["doc_id"], r["ref_doc_id"], r["end"] - r["start"]) for r in passages.passages(wide, batch_bytes=100_000, bucket_bytes=50_000).collect()}
    assert {(6, 3, 330_000)} <= found and {k for k, *_ in found} <= {6, 7}
    pieces = packing.packed(wide, path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids = {r["doc_id"]: r["n_tokens"] for r in token_ids.encoded(wide, path("word_bpe_49k.json")).collect()}
    assert len(pieces) == len(ids) == 7 and all(ids[k] > n[k] for k in n)


def test_a_null_or_repeated_doc_id_is_scored_like_another(spark):
    rows = [(None, "a b c"), (None, "a b c d"), (5, "a b c"), (5, "a b c"), (5, "x y"), (7, "")]
    got = collections.Counter((r["doc_id"], r["n_words"], r["score"] and round(r["score"], 9)) for r in lm_scores.scores(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=4, bucket_bytes=4).collect())
    one = collections.Counter((r["doc_id"], r["n_words"], r["score"] and round(r["score"], 9)) for r in lm_scores.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == one and sum(got.values()) == 6 and sum(k[1] for k in got.elements()) == 15


def test_votes_of_whole_texts_like_a_loop(spark, texts, documents, labels):
    model = quality_votes.fit(documents, labels)
    got = {r["doc_id"]: r["score"] for r in quality_votes.score(documents, model).collect()}
    for key in sorted(texts)[:25]:
        data = [ord("0") if 48 <= b < 58 else b for b in texts[key].encode()]
        place = quality_votes._PLACE.astype(object)
        terms = np.zeros(quality_votes.TERMS)
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            h = place[0][a] ^ (place[1][b] * 5 % 2**32) ^ (place[2][c] * 25 % 2**32)
            terms[(h ^ (h >> 15)) % (quality_votes.TERMS - 8)] += 1
        terms = np.log1p(terms)
        size, words = np.linalg.norm(terms), WORD.findall(texts[key])
        terms[-1] = size * sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(len(words), 1)
        terms[-2] = size * min(sum(texts[key].count(c) for c in "#*$%&|<>!") / max(len(words), 1), 1)
        latent = terms / max(np.linalg.norm(terms), 1e-12) @ model.weights
        near = model.vectors @ (latent / max(np.linalg.norm(latent), 1e-12))
        best = near >= np.sort(near)[-quality_votes.NEIGHBOURS] - 1e-6
        weight = np.maximum(near, 0) ** quality_votes.SHARPNESS * best
        assert got[key] == pytest.approx((weight * model.labels).sum() / weight.sum(), abs=1e-3)


# ---- the pipeline's stages ----


def test_pipeline_stages_by_hand(spark, sf_dir):
    import corpus_pipeline as P

    pd_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality_rules.learned_rules(pd_docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = quality_rules.with_features(quality_rules.text_stats(pd_docs)).toPandas().set_index("doc_id")
    good = set()
    for r in pd_docs.collect():
        n_words, _, _, _, repeated = counts_by_hand(r["text"])
        one = {f: np.array([stats.loc[r["doc_id"], f]]) for f in quality_rules.FEATURES}
        if n_words >= 20 and 100 * repeated <= 30 * n_words and not any(all(t.holds(one)[0] for t in rule) for rule in rules):
            good.add(r["doc_id"])
    docs = P.filter_quality(spark, pd_docs, sf_dir).persist()
    assert {r["doc_id"] for r in docs.collect()} == good

    docs = P.drop_near_copies(spark, docs, sf_dir).persist()
    spans = collections.defaultdict(set)
    for r in passages.passages(docs).collect():
        spans[r["doc_id"]] |= set(range(r["start"], r["end"]))
    cut = P.cut_passages(spark, docs, sf_dir).persist()
    after = {r["doc_id"]: r["text"].split() for r in cut.collect()}
    for r in docs.collect():
        words = WORD.findall(r["text"])
        assert after.get(r["doc_id"], []) == [w for j, w in enumerate(words) if j not in spans[r["doc_id"]]]

    mixed = {r["doc_id"] for r in P.mix_sources(spark, cut, sf_dir).collect()}
    with duckdb.connect() as con:
        con.register("documents", cut.toPandas())
        assert {k for (k,) in con.execute(f"WITH {mixing.mixing_sql()} SELECT doc_id FROM mixed WHERE kept").fetchall()} == mixed

    last = cut.where(F.col("doc_id").isin(list(mixed)))
    library = __import__("quire.llm._tokens", fromlist=["_library"])._library(path("byte_bpe_50k.json"))
    want, lengths = collections.Counter(), collections.Counter()
    for r in last.collect():
        ids, start = [*library.encode(r["text"], add_special_tokens=False).ids, 2], 0
        for k, n in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            want[r["doc_id"], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            lengths[n] += 1
            start += n
    rows = P.pack(spark, last, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == packing.plan(lengths, packing.CAPACITY)[1]
    for df in (docs, cut):
        df.unpersist()
