"""Packing against a plain search of all windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm.packing import STEP_TOKENS, pack, pack_documents, steps
from loomdex.llm.packing import WINDOWS as TIERS
from loomdex.llm.pretokens import VOCABULARY, encoding
from loomdex.llm.queries import op7_hierarchical_packing
from loomdex.llm.tokens import end_id

WINDOWS = (16, 64, 256)


def brute(lengths, windows):
    sizes, used, at, offset = [], [], [], []
    for n in lengths:
        tier = min(w for w in windows if w >= n)
        free = [(sizes[w] - used[w], w) for w in range(len(sizes)) if sizes[w] - used[w] >= n]
        for fits in ([f for f in free if sizes[f[1]] > tier], [f for f in free if sizes[f[1]] == tier]):
            if fits:
                w = min(fits)[1]
                break
        else:
            w = len(sizes)
            sizes.append(tier)
            used.append(0)
        at.append(w)
        offset.append(used[w])
        used[w] += n
    return at, offset, sizes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=80))
def test_equals_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    at, offset, sizes = pack(lengths, WINDOWS)
    assert (at.tolist(), offset.tolist(), sizes) == brute(lengths, WINDOWS)


def test_steps_are_balanced():
    rng = np.random.default_rng(0)
    sizes = np.repeat([256, 64], [40, 100])
    used = (sizes * rng.uniform(0.3, 1, len(sizes))).astype(int)
    step = steps(sizes, used, 512)
    for size in (256, 64):
        own = step[sizes == size]
        counts = np.unique(own, return_counts=True)[1]
        assert counts.max() <= 512 // size and counts.max() - counts.min() <= 1
        loads = np.array([used[step == s].sum() for s in np.unique(own)])
        assert loads.max() - loads.min() <= size
    assert not set(step[sizes == 256]) & set(step[sizes == 64])


def _ids(r):
    return np.frombuffer(bytes(r["ids"]), "<u2").tolist()


def _check(rows, texts, windows, step_tokens):
    """Every document is put together again from the windows alone; windows and steps keep their sizes."""
    encode, found, steps_of = encoding(VOCABULARY).encode_ordinary, defaultdict(list), defaultdict(set)
    for r in rows:
        ids, at = _ids(r), 0
        assert r["n_tokens"] == len(ids) <= r["window_tokens"] and r["window_tokens"] in windows
        for p in r["pieces"]:
            assert p["offset"] == at and p["n_tokens"] > 0
            at += p["n_tokens"]
            found[p["doc_id"]].append((p["start"], ids[p["offset"] : at]))
        assert at == len(ids)
        steps_of[r["pack_group"], r["step"]].add((r["window"], r["window_tokens"]))
    assert len({(r["pack_group"], r["window"]) for r in rows}) == len(rows)
    want = defaultdict(list)
    for doc_id, text in texts:
        if text:
            want[doc_id] += [*encode(text), end_id()]
    assert set(found) == set(want)
    for doc_id, parts in found.items():
        got, at = [], 0
        for start, ids in sorted(parts):
            assert start in (0, at)  # rows that repeat a doc_id begin anew
            at = start + len(ids)
            got += ids
        assert got == want[doc_id] or sorted(got) == sorted(want[doc_id]) and len(parts) > 1
    for own in steps_of.values():
        assert len({size for _, size in own}) == 1 and sum(size for _, size in own) <= step_tokens


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for group_tokens in (1 << 26, 1 << 16):
        rows = pack_documents(docs, (512, 2048, 8192), step_tokens=1 << 14, group_tokens=group_tokens).collect()
        _check(rows, texts, (512, 2048, 8192), 1 << 14)
        assert sum(r["n_tokens"] for r in rows) > 0.9 * sum(r["window_tokens"] for r in rows)
    assert len({r["pack_group"] for r in rows}) > 1


def test_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    _check(op7_hierarchical_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs], TIERS, STEP_TOKENS)


def test_windows_equal_brute_force(spark):
    """The whole plan of one group: sizes, places and contents by the plain search."""
    rng = np.random.default_rng(3)
    docs = [(i, " a" * int(rng.integers(1, 250))) for i in range(120)]
    rows = pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), WINDOWS, 512).collect()
    encode = encoding(VOCABULARY).encode_ordinary
    order = sorted(docs, key=lambda d: (-len(encode(d[1])), d[0]))
    at, offset, sizes = brute([len(encode(t)) + 1 for _, t in order], WINDOWS)
    want = sorted((w, sizes[w], o, d) for (d, _), w, o in zip(order, at, offset))
    assert sorted((r["window"], r["window_tokens"], p["offset"], p["doc_id"]) for r in rows for p in r["pieces"]) == want


def test_table_cases(spark):
    long = " a" * 999
    rows = [(1, " a" * 9, "x"), (2, " a" * 9, "x"), (2, " a" * 9, "x"), (None, " a" * 4, "x"), (None, " a" * 4, "x"), (3, None, "x"), (4, "", "x"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `window` string").withColumn("step", F.lit("clash")).withColumn("ids", F.lit(1))
    got = pack_documents(docs, WINDOWS, 512).collect()
    _check(got, [r[:2] for r in rows], WINDOWS, 512)
    parts = sorted((p["doc_id"] or 0, p["start"], p["n_tokens"]) for r in got for p in r["pieces"])
    assert parts == [(0, 0, 5), (0, 0, 5), (1, 0, 10), (2, 0, 10), (2, 0, 10), (5, 0, 256), (5, 256, 256), (5, 512, 256), (5, 768, 232)]
    assert pack_documents(docs.limit(0), WINDOWS, 512).count() == 0
    for bad in ((), (0, 4)):
        with pytest.raises(ValueError):
            pack_documents(docs, bad)
    with pytest.raises(ValueError):
        pack_documents(docs, WINDOWS, step_tokens=100)


def test_copies_go_to_many_groups(spark):
    """Rows that are all alike are no hot key."""
    docs = spark.range(300).selectExpr("7L as doc_id", "'the same text again' as text")
    rows = pack_documents(docs, WINDOWS, 512, group_tokens=64).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["pack_group"]] += r["n_tokens"]
    assert len(sizes) > 15 and max(sizes.values()) < 10 * 64 and sum(len(r["pieces"]) for r in rows) == 300
