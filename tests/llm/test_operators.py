"""Each operator against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language_id, lm_scores, mixing, ngram_jaccard, packing, passages, quality_rules, quality_votes, tiff, token_ids
from quire.llm._graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


# ---- quality rules ----


def counts_by_hand(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = collections.Counter(grams)
    repeated = {i for k, g in enumerate(grams) if often[g] > 1 for i in range(k, k + 8)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(repeated)


def test_counts(documents, texts, odd_docs):
    for docs, want in ((documents, texts), (odd_docs, {r["doc_id"]: r["text"] for r in odd_docs.collect()})):
        for r in quality_rules.text_stats(docs).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts_by_hand(want[r["doc_id"]])


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(0)
    rows = {name: rng.random(600) for name in quality_rules.FEATURES}
    bad = ((rows["symbol_ratio"] > 0.8) & (rows["mean_word"] < 0.5)) | (rows["mark_ratio"] > 0.9)
    rules = quality_rules.learn(rows, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= quality_rules._covered(rule, rows, 600)
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.05 * (~bad).sum()


def test_verdicts_agree_with_the_rules(documents, labels, odd_docs, no_docs):
    rules = quality_rules.learned_rules(documents, labels)
    found = quality_rules.judge(documents, rules).toPandas()
    by_rule = np.zeros(len(found), bool)
    for rule in rules:
        by_rule |= quality_rules._covered(rule, {k: found[k].to_numpy() for k in quality_rules.FEATURES}, len(found))
    base = (found.n_words < 20) | (100 * found.n_repeat_words > 30 * found.n_words)
    assert (found.base_failed == base).all() and (found.kept == ~(base | by_rule)).all()
    marked = labels.toPandas().merge(found, on="doc_id")
    good, bad = marked[marked.quality == 1], marked[marked.quality == 0]
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.6
    odd = {r["doc_id"]: r["kept"] for r in quality_rules.judge(odd_docs, rules).collect()}
    assert odd[0] is False and odd[1] is False and len(odd) == 14
    assert quality_rules.judge(no_docs, []).count() == 0
    assert quality_rules.learned_rules(documents, labels.limit(0)) == []


# ---- language, quality ----


def test_language_held_out(documents, odd_docs, no_docs):
    model = language_id.fit(documents)
    found = language_id.predict(documents, model).withColumn("held", language_id.held_out()).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.9 and found.score.between(0, 1).all()
    odd = language_id.predict(odd_docs, model).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2, 12)} == {"und"} and len(odd) == 15
    assert language_id.predict(no_docs, model).count() == 0 and language_id.fit(no_docs) is None
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(16)
    rows = []
    for k in range(70):  # letters of its own for each; the last six have the fewest documents
        letters = [chr(0x4E00 + 40 * k + j) for j in range(4)]
        rows += [(1000 * k + j, " ".join("".join(rng.choices(letters, k=3)) for _ in range(20)), f"l{k:02}") for j in range(40 if k < 64 else 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id >= 64000").toPandas()
    assert model.languages == [f"l{k:02}" for k in range(70)] and (found.lang == found.lang_pred).mean() > 0.9


def test_language_uses_whole_texts_and_no_neighbours(documents):
    model = language_id.fit(documents)
    scorer = language_id.Scorer(model)
    rng = random.Random(5)
    batch = [bytes(rng.choices(b"abcdefgh ", k=n)) for n in (0, 1, 253, 254, 255, 256, 257, 700, 5)]
    at = np.append(0, np.cumsum([len(b) for b in batch]))
    together = scorer.texts(np.frombuffer(b"".join(batch), np.uint8), at)
    for k, one in enumerate(batch):
        alone = scorer.texts(np.frombuffer(one, np.uint8), np.array([0, len(one)]))[0]
        np.testing.assert_allclose(alone, together[k], atol=1e-5)
    # tables give what the filters give
    x = np.frombuffer(batch[7][:260], np.uint8)
    seen = model.embedding[x]
    value = sum(seen[k : k + 256] @ model.filters[k] for k in range(4))
    pair = (x[:-1].astype(int) << 8) | x[1:]
    other = scorer.front[pair[:256]].copy()
    other[:, language_id.FILTERS :] += scorer.rear[pair[2:258]]
    np.testing.assert_allclose(value, other, atol=1e-3)


def test_quality_held_out(documents, labels, odd_docs, no_docs):
    model = quality_votes.fit(documents, labels)
    found = quality_votes.score(documents, model).withColumn("held", language_id.held_out(5, 0)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    if len(bad):
        assert (good[:, None] > bad[None]).mean() > 0.7
    assert found.score.between(0, 1).all()
    odd = quality_votes.score(odd_docs, model).collect()
    by = collections.defaultdict(set)
    for r in odd:
        by[r["doc_id"]].add(r["score"])
    assert len(odd) == 15 and len(by[5]) == 1 and by[0] == by[1] and abs(next(iter(by[0])) - model.labels.mean()) < 1e-6
    assert quality_votes.score(no_docs, model).count() == 0 and quality_votes.fit(documents, labels.limit(0)) is None


def test_votes_like_a_loop():
    rng = np.random.default_rng(2)
    counts = np.log1p(rng.poisson(0.4, (60, quality_votes.TERMS))).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = quality_votes.train(counts, labels)
    got = model.scores(counts[:10])
    near = model.latent(counts[:10]) @ model.vectors.T
    for k in range(10):
        best = np.argsort(-near[k])[: quality_votes.NEIGHBOURS]
        w = np.maximum(near[k][best], 0) ** quality_votes.SHARPNESS
        assert abs(got[k] - (w * labels[best]).sum() / w.sum()) < 1e-4


# ---- TIFF ----


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("layout", [{}, {"tiled": True}, {"predictor": 1}, {"order": ">"}])
def test_tiff_round_trip(compression, layout):
    rng = random.Random(6)
    for data in (b"", b"a", b"ab" * 100, bytes(rng.choices(b"ab", k=9000)), rng.randbytes(5000), b"z" * 70_000):
        payload = tiff.payload_of(data)
        assert b"".join(p.samples for p in tiff.decode(tiff.write_pages(payload, compression=compression, **layout))) == payload


def test_tiff_pages_and_errors(spark):
    many = tiff.write_pages(bytes(64 * (tiff.PAGE_ROWS + 5)))
    files = spark.createDataFrame([(1, many), (2, b"II*"), (3, None), (4, many[:60]), (5, b"nothing")], "id int, media binary")
    rows = tiff.read_pages(files, key="id", media="media").collect()
    assert [(r["page"], r["width"], r["height"]) for r in rows if r["id"] == 1] == [(0, 64, tiff.PAGE_ROWS), (1, 64, 5)]
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4, 5}
    # known bytes of the packed form
    assert tiff.packbits_unpack(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def test_tiff_bilevel_and_planes():
    import struct

    def ifd(fields, data):
        out = bytearray(b"II*\0" + struct.pack("<I", 8 + len(data)) + data)
        out += struct.pack("<H", len(fields))
        for tag, value in sorted(fields.items()):
            out += struct.pack("<HHII", tag, 4, 1, value)
        return bytes(out + b"\0" * 4)

    one = {tiff.IMAGE_WIDTH: 10, tiff.IMAGE_LENGTH: 2, tiff.STRIP_OFFSETS: 8, tiff.STRIP_BYTE_COUNTS: 4, tiff.ROWS_PER_STRIP: 2}
    (page,) = tiff.decode(ifd(one, bytes([0b10000000, 0b01000000, 0b11111111, 0b11000000])))
    assert page.bits == 1 and list(page.samples) == [1] + [0] * 8 + [1] + [1] * 10


def test_tiff_digests(odd_docs, no_docs):
    import hashlib

    rows = tiff.digests(tiff.texts_as_tiff(odd_docs)).collect()
    want = {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.collect()}
    for r in rows:
        payload = tiff.payload_of(want[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(rows) == 15 and tiff.digests(tiff.texts_as_tiff(no_docs)).count() == 0


# ---- language model ----


def lm_by_hand(texts, least=2, backoff=0.4):
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    c = [collections.Counter() for _ in range(4)]
    for w in words.values():
        for n in (1, 2, 3):
            c[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, out = sum(c[1].values()), {}
    for key, w in words.items():
        score = 0.0
        for k in range(len(w)):
            tri, bi = tuple(w[k - 2 : k + 1]), tuple(w[k - 1 : k + 1])
            if k >= 2 and c[3][tri] >= least:
                score += np.log(c[3][tri] / c[2][tri[:2]])
            elif k >= 1 and c[2][bi] >= least:
                score += np.log(backoff * c[2][bi] / c[1][bi[:1]]) if k >= 2 or True else 0
            else:
                score += np.log(backoff**2 * c[1][(w[k],)] / total)
        out[key] = score / len(w) if w else None
    return out


def test_lm_scores(documents, texts, odd_docs, no_docs):
    want = lm_by_hand(texts)
    got = {r["doc_id"]: r["score"] for r in lm_scores.scores(documents, batch_bytes=50_000, bucket_bytes=20_000).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    odd = lm_scores.scores(odd_docs).collect()
    assert len(odd) == 15 and all((r["score"] is None) == (r["n_words"] == 0) for r in odd)
    assert lm_scores.scores(no_docs).count() == 0


def test_lm_packing_round_trip():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**48, 5000).astype(np.uint64))
    n = rng.integers(1, 2**31, 5000)
    back, counts = lm_scores.unpack(*lm_scores.pack(h, n))
    assert (back == h).all() and (counts == n).all()


# ---- packing, token ids ----


def test_plan_fills_and_never_overflows():
    rng = random.Random(7)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        rows, sequences = packing.plan(counts, 64)
        used, seen = collections.Counter(), collections.Counter()
        places = collections.defaultdict(list)
        for length, lo, count, base, per, at in rows:
            assert lo == seen[length]
            seen[length] += count
            for k in range(count):
                places[base + k // per].append((at + k % per * length, length))
                used[base + k // per] += length
        assert seen == counts and len(used) == sequences and max(used.values()) <= 64
        for items in places.values():
            end = 0
            for at, length in sorted(items):
                assert at == end
                end += length
        # never more than the textbook bound of best fit decreasing
        assert sequences <= 11 / 9 * -(-sum(k * v for k, v in counts.items()) // 64) + 1 or max(counts) > 32


def test_packing_pieces(odd_docs, no_docs):
    library_path = path("byte_bpe_50k.json")
    from quire.llm._tokens import _library

    library = _library(library_path)
    rows = packing.packed(odd_docs, library_path, capacity=128, keep_ids=True).collect()
    want = collections.Counter()
    for r in odd_docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        start = 0
        for number, n in enumerate(packing.cut(len(ids), 128)):
            want[r["doc_id"], number, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 128
    assert packing.packed(no_docs, library_path).count() == 0


def test_code_lengths_are_optimal_under_the_limit():
    def best(counts, most):  # all ways to give few symbols lengths that fit
        import itertools

        return min(sum(n * d for n, d in zip(counts, depths, strict=True)) for depths in itertools.product(range(1, most + 1), repeat=len(counts)) if sum(2.0**-d for d in depths) <= 1)

    rng = random.Random(8)
    for _ in range(25):
        counts = {k: rng.choice([1, 1, 2, 5, 40, 300]) for k in range(rng.randint(2, 6))}
        lengths = token_ids.code_lengths(counts, 4)
        assert max(lengths.values()) <= 4 and sum(2.0**-d for d in lengths.values()) <= 1
        assert sum(counts[k] * lengths[k] for k in counts) == best(list(counts.values()), 4)
    assert token_ids.code_lengths({}) == {} and token_ids.code_lengths({7: 3}) == {7: 1}


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000)
    code = token_ids.Code(token_ids.code_lengths(dict(collections.Counter(ids.tolist()))))
    bits, checkpoints = code.encode(ids)
    assert (code.decode(bits, checkpoints, n) == ids).all() and len(checkpoints) == -(-n // token_ids.STRIDE)


def test_token_ids_of_documents(documents, texts, odd_docs, no_docs):
    from quire.llm._tokens import _library

    name = path("word_bpe_49k.json")
    library, start = _library(name), 0
    got = {r["doc_id"]: r for r in token_ids.encoded(documents, name).collect()}
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 1]
        r = got[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = sorted(token_ids.encoded(odd_docs, name).collect(), key=lambda r: r["start"])
    assert odd[0]["doc_id"] is None and [r["doc_id"] for r in odd[1:]] == sorted(r["doc_id"] for r in odd[1:]) and len(odd) == 15
    assert token_ids.encoded(no_docs, name).count() == 0


# ---- near copies ----


def sets_by_hand(texts, n):
    out = {}
    for key, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[key] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def components_by_hand(sets, num, den):
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize(("n", "ratio"), [(4, (85, 100)), (5, (80, 100)), (2, (50, 100))])
def test_jaccard_components_of_edited_copies(spark, n, ratio):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = {}
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 80))
        for _ in range(rng.choice([1, 2, 12])):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.1]) else w for w in base]
            texts[len(texts)] = " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.joined(docs, n=n, ratio=ratio).collect()}
    sets = sets_by_hand(texts, n)
    want = components_by_hand(sets, *ratio)
    assert got == {k: (len(sets[k]), want[k]) for k in texts}


@pytest.mark.parametrize(("n", "ratio"), [(4, (85, 100)), (2, (50, 100))])
def test_jaccard_links_of_edited_copies(spark, odd_docs, no_docs, n, ratio):
    rng = random.Random(20 + n)
    texts = {}
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 90))]
        for _ in range(12):
            some = rng.choices(range(len(base)), k=rng.randint(0, 1))
            texts[len(texts)] = " ".join(f"w{rng.randrange(300)}" if j in some else w for j, w in enumerate(base))
    found = ngram_jaccard.links(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), n=n, ratio=ratio).collect()
    sets = sets_by_hand(texts, n)
    reps = {}
    for key in sorted(sets):
        reps.setdefault(frozenset(sets[key]), key)
    keys = sorted(reps.values())
    common = {(a, b): len(sets[a] & sets[b]) for a in keys for b in keys if a < b}
    want = {(a, b) for (a, b), c in common.items() if ratio[1] * c >= ratio[0] * (len(sets[a]) + len(sets[b]) - c)}
    assert sorted((r["a"], r["b"]) for r in found) == sorted(want) and len(want) > 10
    assert [(r["a"], r["b"]) for r in ngram_jaccard.links(odd_docs).orderBy("a").collect()] == [(5, 7), (8, 9)] and ngram_jaccard.links(no_docs).count() == 0


def test_jaccard_odd_documents(odd_docs, no_docs):
    rows = ngram_jaccard.joined(odd_docs).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 15 and found[0] == (0, 0) and found[2] == (0, 2) and found[3] == (1, 3) and found[4] == (1, 4)
    assert found[5] == found[6] and found[6][1] == 5 and found[7][1] == 5 and found[10][0] == 1 and found[None][1] is None
    assert ngram_jaccard.joined(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(a, a + 1) for a in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in alone}


# ---- passages ----


def test_chains_like_a_quadratic_search():
    rng = random.Random(10)
    for _ in range(30):
        x = np.sort(np.array(rng.sample(range(200), 25)))
        y = np.array([rng.choice([v, v + 3, rng.randint(0, 200)]) for v in x.tolist()])
        score = [1.0] * 25
        for i in range(25):
            for j in range(i):
                if y[j] < y[i]:
                    score[i] = max(score[i], 1 + score[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) / 2)
        chains = passages.chain(x, y, 0.1, 10_000)
        assert sorted(k for c in chains for k in c) == list(range(25))
        first = chains[0]
        assert all(y[a] < y[b] for a, b in zip(first, first[1:], strict=False))
        worth = len(first) - sum(0.1 * (x[b] - x[a] + y[b] - y[a]) / 2 for a, b in zip(first, first[1:], strict=False))
        assert abs(worth - max(score)) < 1e-9


def test_passages_are_found_and_cut(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(70)]
    edited = [w if k % 23 else word() for k, w in enumerate(passage)]
    short = [word() for _ in range(40)]
    docs = {k: [word() for _ in range(100)] for k in range(12)}
    docs[1][50:50], docs[2][20:20], docs[3][0:0] = passage, passage, edited
    docs[4][10:10], docs[5][60:60] = short, short
    docs[6] = list(docs[1])
    table = spark.createDataFrame([(k, " ".join(w), "x", len(" ".join(w))) for k, w in docs.items()], "doc_id long, text string, start string, n_chars long")
    found = passages.passages(table).collect()
    assert {r["doc_id"] for r in found} == {2, 3, 6}
    spans = {r["doc_id"]: (r["start"], r["end"], r["ref_doc_id"], r["ref_start"], r["ref_end"]) for r in found}
    assert spans[2] == (20, 90, 1, 50, 120) and spans[6] == (0, 170, 1, 0, 170)
    assert spans[3][0] <= 1 and spans[3][1] >= 69
    left = {r["doc_id"]: r for r in passages.cut(table, passages.passages(table)).collect()}
    assert 6 not in left and left[2]["text"].split() == docs[2][:20] + docs[2][90:] and left[2]["n_chars"] == len(left[2]["text"])
    assert left[0]["text"] == " ".join(docs[0]) and left[1]["text"].split() == docs[1] and left[2]["start"] == "x"


def test_passages_odd_documents(odd_docs, no_docs):
    found = passages.passages(odd_docs).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(6, 5), (7, 5), (9, 8)}
    assert passages.passages(no_docs).count() == 0
    assert passages.cut(odd_docs, passages.passages(odd_docs)).count() == 14  # of 15 rows, the whole copy goes


def covered(found):
    """(doc_id, place) of all words in passages."""
    return {(r["doc_id"], k) for r in found for k in range(r["start"], r["end"])}


def repeated_by_hand(docs, least=50):
    """(doc_id, place) of all words in runs of ``least`` words that an earlier document holds."""
    held, out = set(), set()
    for key in sorted(docs):
        grams = [tuple(docs[key][k : k + least]) for k in range(len(docs[key]) - least + 1)]
        out |= {(key, j) for k, g in enumerate(grams) if g in held for j in range(k, k + least)}
        held |= set(grams)
    return out


def word_table(spark, docs):
    return spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")


def test_passages_of_runs_of_a_word_or_a_line(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, want = {}, set()
    for n, size in enumerate((1, 3, 8, 12)):
        line = [word() for _ in range(size)]
        for k in range(2):
            head = [word() for _ in range(20)]
            docs[2 * n + k] = head + line * (96 // size) + [word() for _ in range(20)]
        want |= {(2 * n + 1, j) for j in range(20, 20 + 96 // size * size)}
    found = passages.passages(word_table(spark, docs)).collect()
    assert want <= covered(found) and len(covered(found) - want) < 10


def test_passages_whose_pieces_occur_in_earlier_documents(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = {}
    for n in range(12):
        passage = [word() for _ in range(98)]
        for k, piece in enumerate((passage[:49], passage[49:], passage[25:73], passage, passage)):
            docs[100 * k + n] = [word() for _ in range(20)] + piece + [word() for _ in range(20)]
    want = {(400 + n, j) for n in range(12) for j in range(20, 118)}
    assert want == repeated_by_hand(docs)
    assert want <= covered(passages.passages(word_table(spark, docs)).collect())


def test_whole_runs_like_brute_force(spark, texts):
    rng = random.Random(14)
    docs = {}
    for key in range(60):  # few words and short lines, so that seeds recur within documents
        line = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        docs[key] = [w for _ in range(rng.randint(1, 12)) for w in (line * rng.randint(1, 9) if rng.random() < 0.5 else rng.choice([*docs.values(), line])[rng.randint(0, 40) :][: rng.randint(1, 70)])]
    for table in (docs, {k: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for k, t in texts.items()}):
        found = passages._whole_runs(word_table(spark, table), 50).collect()
        assert covered(found) == repeated_by_hand(table)
        assert all(table[r["doc_id"]][r["start"] : r["end"]] == table[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]] and r["ref_doc_id"] < r["doc_id"] for r in found)
        assert repeated_by_hand(table) <= covered(passages.passages(word_table(spark, table)).collect())


@pytest.mark.parametrize(("share", "spread"), [(0.95, False), (0.9, False), (0.85, False), (0.8, False), (0.9, True), (0.8, True)])
def test_passages_of_edited_words(spark, share, spread):
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, many = {}, 100
    for n in range(many):
        passage = [word() for _ in range(50)]
        other = round(50 * (1 - share))
        where = set(range(2, 49, 50 // other)) if spread else set(rng.sample(range(1, 49), other))
        for k, words in enumerate((passage, [word() if j in where else w for j, w in enumerate(passage)])):
            docs[many * k + n] = [word() for _ in range(30)] + words + [word() for _ in range(30)]
    found = {r["doc_id"] for r in passages.passages(word_table(spark, docs)).collect() if r["ref_doc_id"] == r["doc_id"] - many and r["start"] < 60 and r["end"] > 50}
    assert len(found) >= 0.97 * many


# ---- mixing ----


def test_mixing_meets_its_targets(documents, odd_docs, no_docs):
    cells = documents.withColumn("topic", mixing.topic()).withColumn("n_tokens", mixing.tokens()).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked = mixing.raked(cells, mixing.EXPONENTS, 20).toPandas()
    assert abs(raked.weight.sum() - 1) < 1e-9
    for name, power in mixing.EXPONENTS.items():
        want = raked.groupby(name).tokens.sum() ** power
        np.testing.assert_allclose(raked.groupby(name).weight.sum(), want / want.sum(), rtol=0.02)
    found = mixing.mixed(documents, share=0.5).toPandas()
    assert abs((found.n_tokens * found.probability).sum() / found.n_tokens.sum() - 0.5) < 0.01
    odd = mixing.mixed(odd_docs).collect()
    assert len(odd) == 15 and all(0 <= r["probability"] <= 1 for r in odd)
    assert mixing.mixed(no_docs).count() == 0


def test_mixing_draws_by_the_probability(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    kept = mixing.mixed(docs, share=0.3).where("kept").count()
    assert abs(kept / 20_000 - 0.3) < 0.02
