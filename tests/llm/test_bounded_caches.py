"""Caches of workers on texts without blanks, each of which is one word of any length."""

import pickle

import numpy as np
import pytest

from trajecta.llm import bpe, pieces, toxicity
from trajecta.llm.common import KEPT


def _texts(n, size=300):
    r = np.random.default_rng(3)
    return ["".join(map(chr, row)) for row in r.integers(0x4E00, 0x9FA6, (n, size)).tolist()]


def test_token_cache_keeps_short_chunks_only():
    enc, texts = bpe.ChunkEncoder(bpe.VOCABULARY), _texts(20_000, 60)
    mixed = [f"{t} größer ƒ{k}" for k, t in enumerate(texts)]
    got = []
    for i in range(0, len(mixed), 2_000):
        ids, count = enc.encode([t.encode() for t in mixed[i : i + 2_000]])
        got += np.split(ids, np.cumsum(count)[:-1])
        assert max(map(len, enc.chunks), default=0) <= KEPT
    assert sum(len(k) + v.nbytes for k, v in enc.chunks.items()) < 4 << 20
    assert all(v.base is None for v in enc.chunks.values())
    for k in range(0, len(mixed), 997):
        assert got[k].tolist() == enc.tok.encode(mixed[k], add_special_tokens=False).ids


def test_token_counts_of_long_chunks_are_the_library_s(spark):
    texts = [*_texts(200, 900), "a" * 5000, "ab " * 300, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = bpe.encoder(bpe.VOCABULARY)
    want = {k: len(enc.tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == want


def test_frequent_chunks_are_short(spark):
    texts = [f"{t} common words" for t in _texts(50)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = bpe.frequent_chunks(df)
    assert found == [b"common", b"words"] and len(pickle.dumps(found)) < 1000


def test_piece_cache_keeps_short_words_only():
    p = pieces.pieces(pieces.MODEL)
    p.words.clear()
    texts = _texts(20_000, 80)
    mixed = [f"{t} short words {k % 50}" for k, t in enumerate(texts)]
    got = pieces.plain_ids(mixed, pieces.MODEL)
    assert max(map(len, p.words)) <= KEPT and sum(4 * len(k) + len(v) for k, v in p.words.items()) < 1 << 20
    for k in range(0, len(mixed), 997):
        assert np.frombuffer(got[k], np.int32).tolist() == p.sp.encode(mixed[k])


def test_margin_holds_the_longest_piece(monkeypatch):
    assert pieces.pieces(pieces.MODEL).longest <= pieces.MARGIN
    monkeypatch.setattr(pieces, "MARGIN", 3)
    with pytest.raises(ValueError, match="margin"):
        pieces.Pieces(pieces.MODEL)


def test_word_caches_keep_short_words_only():
    words, kinds = toxicity.Words(), toxicity.Kinds(toxicity.Lexicon({"bad": 1.0}, {}))
    long = [t.encode() for t in _texts(500)]
    for c in [*long, b"bad", b"good", b"B4D"]:
        assert words[c] == toxicity.word(c)
        assert kinds[c] == kinds[c]
    assert set(words) == set(kinds) == {b"bad", b"good", b"B4D"}
    assert kinds.table[kinds[b"bad"]][0] == 1.0
