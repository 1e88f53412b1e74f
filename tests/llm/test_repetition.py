"""The suffix-array rule against a search of all substrings."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm import repetition
from loomdex.llm.repetition import keep_unrepetitive, repeats, repetition_report, suffix_lcp

PROSE = "The quick brown fox jumps over the lazy dog while seventeen engineers quietly watch the harbour lights fade."


def brute(text: str | None, least: int) -> tuple[int, int, int]:
    """For every start the longest substring that starts elsewhere too."""
    text = text or ""
    n, covered, longest = len(text), set(), 0
    if n <= least:
        return n, 0, 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    return n, len(covered), longest


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c", max_size=60), st.integers(2, 9))
def test_equals_brute_force(text, least):
    assert repeats(text, least) == brute(text, least)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé漢\U0001f600", max_size=40), st.integers(2, 6))
def test_equals_brute_force_beyond_latin(text, least):
    assert repeats(text, least) == brute(text, least)


def test_suffix_array_is_sorted():
    text = "mississippi" * 7 + "banana"
    order, lcp = suffix_lcp(np.frombuffer(text.encode(), np.uint8))
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    for a, b, n in zip(order, order[1:], lcp[1:]):
        assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] != text[b + n : b + n + 1] or a + n == len(text) or b + n == len(text)


def test_very_long_texts():
    unique = "".join(chr(97 + x) for x in np.random.default_rng(0).integers(0, 26, 300_000))
    assert repeats(unique)[1:] == (0, 0)
    assert repeats(unique + unique[:5000]) == (305_000, 10_000, 5000)
    n, covered, longest = repeats("a" * 200_000)
    assert (covered, longest) == (200_000, 199_999)


def test_table_cases(spark):
    rows = [
        (1, PROSE, "x", 9), (2, None, "x", 9), (3, "", None, None), (4, (PROSE + "\n") * 20, "x", 9), (None, PROSE, "x", 9), (1, PROSE, "x", 9), (4, (PROSE + "\n") * 20, "y", 8), (6, "short", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Repetition string, `repetition_1` int")
    kept = keep_unrepetitive(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted((r for r in docs.collect() if r["doc_id"] != 4), key=repr)
    assert keep_unrepetitive(docs.limit(0)).count() == 0


def test_report(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None), (3, PROSE + " " + PROSE), (4, "")], "doc_id bigint, text string").withColumn("m", F.lit("clash"))
    got = {r["doc_id"]: r for r in repetition_report(docs).collect()}
    assert set(got) == {1, 2, 4} and got[2]["covered_fraction"] == 0.0 and got[1]["chars"] == len(PROSE)
    loose = {r["doc_id"]: r for r in repetition_report(docs, max_covered=1.0).collect()}
    assert (loose[3]["covered"], loose[3]["longest"]) == brute(PROSE + " " + PROSE, repetition.MIN_REPEAT)[1:]


def test_limits_are_inclusive(spark):
    text = "0123456789" * 2 + "abcdefghijklmnopqrst"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert keep_unrepetitive(docs, 10, 0.5, 10).count() == 1
    assert keep_unrepetitive(docs, 10, 0.49, 10).count() == 0
    assert keep_unrepetitive(docs, 10, 0.5, 9).count() == 0
