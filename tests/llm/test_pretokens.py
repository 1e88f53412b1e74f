"""Pre-tokens and ids of many texts at once against the encoder, text by text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import pretokens
from loomdex.llm.pretokens import VOCABULARY, Pieces, decoded, encoding, piece_counts, text_ids
from loomdex.llm.shingles import string_buffers

PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "''", " ", "  ", "\n", "\t", "\xa0", "　", "1", "٣", "é", "漢", "\U0001f600", "!", "-", "Ⅷ", "́", "\x85", " ", "S", "'s", "don't", "\r\n", "\x1c", "ß"]


def _got(texts, path=VOCABULARY):
    offsets, data = string_buffers(pa.array(texts, pa.string()))
    runs = list(text_ids(path, offsets, data))
    return np.concatenate([np.zeros(0, int), *(i for i, _ in runs)]).tolist(), np.concatenate([np.zeros(0, int), *(n for _, n in runs)]).tolist(), piece_counts(path, offsets, data).tolist()


def _check(texts):
    want = [encoding(VOCABULARY).encode_ordinary(t or "") for t in texts]
    ids, n, counts = _got(texts)
    assert n == counts == [len(w) for w in want] and ids == [i for w in want for i in w]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_equals_the_encoder(texts):
    _check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20), max_size=4))
def test_any_characters(texts):
    _check(texts)


def test_the_documents(spark, sf_dir):
    _check([r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])


def test_long_and_missing_texts(monkeypatch):
    monkeypatch.setattr(pretokens, "TEXT_BYTES", 100)
    monkeypatch.setattr(pretokens, "HASH_BYTES", 64)
    _check(["word " * 3000, None, "", " " * 500, "\n" * 300, "a" * 2000, "漢字" * 400, "tail"])
    assert _got([]) == ([], [], []) and _got([None]) == ([], [0], [0])


def test_a_full_table(monkeypatch):
    """Pre-tokens whose places are taken, and a table that is cleared, give the same ids."""
    monkeypatch.setattr(pretokens, "SLOTS", 8)
    monkeypatch.setattr(pretokens, "TEXT_BYTES", 50)
    texts = [" ".join(f"w{i * j % 37}x" for j in range(20)) for i in range(20)]
    want = [encoding(VOCABULARY).encode_ordinary(t) for t in texts]
    pieces = Pieces(VOCABULARY, True)
    offsets, data = string_buffers(pa.array(texts))
    got = []
    for size, at, per_text in pieces.parts(offsets, data):
        got += [int(pieces.ids[a + k]) for a, n in zip(at, size) for k in range(n)]
    assert got == [i for w in want for i in w]


def test_equal_first_hashes(monkeypatch):
    """Pre-tokens that share the first hash are told apart by the second."""
    real = pretokens.range_hashes

    def same(data, starts):
        _, b = real(data, starts)
        return np.zeros(len(b), np.uint64), b

    monkeypatch.setattr(pretokens, "range_hashes", same)
    monkeypatch.setattr(pretokens, "_KEPT", {})
    _check(["one two three two one", "three four one"])


@pytest.mark.parametrize("text", ["plain", "é漢\U0001f600", ""])
def test_decoding(text):
    ids = np.array(encoding(VOCABULARY).encode_ordinary(text), np.int64)
    data, offsets = decoded(VOCABULARY, ids, np.array([len(ids)]))
    assert data.tobytes().decode() == text and offsets.tolist() == [0, len(text.encode())]
