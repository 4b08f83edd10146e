"""Words, hashes and ids of byte buffers, against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import _text as T

ODD = ["", None, " ", "a", "  a  b\t\nc\x0b", "é  x", "İ ß 語 😀", "a b c d e f g h a b c d e f g h", "\n\n", "x" * 3000]
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \t\n\x0b\x85é 語"), max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_like_the_pattern(batch):
    got = []
    for piece in T.pieces(pa.array(batch, pa.string()), 64):
        w = T.words(piece)
        raw = piece.data.tobytes()
        for d in range(piece.docs):
            got.append([raw[w.begin[k] : w.end[k]].decode() for k in range(w.at[d], w.at[d + 1])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in batch]


def test_equal_ranges_have_equal_hashes():
    piece = next(T.pieces(pa.array(ODD, pa.string())))
    w = T.words(piece)
    raw = piece.data.tobytes()
    seen: dict[bytes, int] = {}
    for b, e, h in zip(w.begin, w.end, w.hash, strict=True):
        assert seen.setdefault(raw[b:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_in_their_document():
    piece = next(T.pieces(pa.array(["a b c", "b c", "c d e f"])))
    w = T.words(piece)
    gram, whole = T.grams(w, 3)
    assert whole.tolist() == [True, False, False, False, False, True, True, False, False]
    assert len({int(x) for x in gram[whole]}) == 3


def test_pieces_cover_all_rows_once():
    batch = pa.array(["x" * random.Random(k).randint(0, 50) for k in range(100)])
    rows = [(p.lo, p.hi) for p in T.pieces(batch, 60)]
    assert rows[0][0] == 0 and rows[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


@pytest.fixture(scope="module")
def vocabularies():
    found = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    return found


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(vocabularies, name):
    from quire.llm import _tokens as K

    path = vocabularies.path(name)
    library = K._library(path)
    rng = random.Random(4)
    letters = list("aZ é'.,|1 \n\t\xc9ß́語😀s't ") + ["it's", "12", "<|endoftext|>", "H̱", "́"]
    batch = [*ODD, "it's he'LL 's", "a<|endoftext|>b", "x　y", "J̌ ǰ", *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(600))]
    encoder = (K.byte_bpe if name.startswith("byte") else K.word_bpe)(path)
    for _ in range(2):  # the second time from the cache
        for piece in T.pieces(pa.array(batch, pa.string()), 500):
            ids, at = encoder.ids(piece)
            for k in range(piece.docs):
                assert ids[at[k] : at[k + 1]].tolist() == library.encode(batch[piece.lo + k] or "", add_special_tokens=False).ids


def test_cache_grows_and_finds():
    from quire.llm._tokens import _Cache

    cache = _Cache(np.uint16)
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 70_000).astype(np.uint64))
    for lo in range(0, len(keys), 9000):
        part = keys[lo : lo + 9000]
        cache.add(part, [[int(k) % 7] * (int(k) % 3) for k in part])
    place = cache.find(keys)
    assert (place == np.arange(len(keys))).all() and (cache.find(keys + np.uint64(1)) < 0).sum() > len(keys) * 0.99
    assert all(cache.ids[cache.begin[p] : cache.begin[p + 1]].tolist() == [int(k) % 7] * (int(k) % 3) for k, p in zip(keys[:500], place[:500], strict=True))
