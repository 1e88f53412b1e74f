"""Token counts and packed ids against the encoder itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm.pretokens import VOCABULARY, encoding
from loomdex.llm.tokens import end_id, id_bits, ids_array, pack_blocks, pack_ids, packed_tokens, read_ids, token_counts, unpack_ids

ROWS = [
    (1, "Hello world, it's 2024!"), (2, None), (3, ""), (5_000_000_000, "漢字 \U0001f600 é\n\n  x"), (-7, "minus"), (None, "no id"), (1, "Hello world, it's 2024!"), (4, "word " * 30_000 + "a" * 5000), (6, "<|endoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id bigint, text string, token string, block int")


def test_counts_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = encoding(VOCABULARY).encode_ordinary
    want = {r["doc_id"]: len(encode(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()} == want


def test_counts_cases(docs):
    encode = encoding(VOCABULARY).encode_ordinary
    want = sorted((str(d), len(encode(t or ""))) for d, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(docs).collect()) == want
    assert token_counts(docs.limit(0)).count() == 0


def test_ids_of_fixed_width():
    texts = ["Hello world", None, "", "漢字"]
    want = [encoding(VOCABULARY).encode_ordinary(t or "") for t in texts]
    for end in (False, True):
        got = [np.frombuffer(b.as_py(), "<u2").tolist() for b in ids_array(pa.array(texts, pa.string()), end=end)]
        assert got == [w + [end_id()] * (end and bool(w)) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 33), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.int64)
    raw = pack_ids(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8) and unpack_ids(raw, bits, len(ids)).tolist() == ids.tolist()
    block = data.draw(st.integers(1, 20))
    raw, offsets = pack_blocks(ids, bits, block)
    lo, hi = data.draw(st.integers(0, 80)), data.draw(st.integers(0, 80))
    assert read_ids(raw, offsets, bits, len(ids), lo, hi, block).tolist() == ids[lo:hi].tolist()
    number = sum(int(x) << (bits * i) for i, x in enumerate(ids))
    assert int.from_bytes(pack_ids(ids, bits), "little") == number


def test_width():
    assert [id_bits(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        pack_ids(np.array([4]), 2)
    with pytest.raises(ValueError):
        id_bits(0)


def test_packed_documents(docs):
    enc = encoding(VOCABULARY)
    want = sorted(((d or 0, enc.encode_ordinary(t or "")) for d, t in ROWS), key=repr)
    rows = packed_tokens(docs, block=100).collect()
    got = sorted(((r["doc_id"] or 0, read_ids(bytes(r["packed"]), r["offsets"], r["bits"], r["n_tokens"], 0, r["n_tokens"], 100).tolist()) for r in rows), key=repr)
    assert got == want
    long = next(r for r in rows if r["doc_id"] == 4)
    ids = enc.encode_ordinary(ROWS[7][1])
    assert read_ids(bytes(long["packed"]), long["offsets"], long["bits"], long["n_tokens"], 12_345, 12_399, 100).tolist() == ids[12_345:12_399]
    assert packed_tokens(docs.limit(0)).count() == 0
