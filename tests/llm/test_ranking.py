"""Pairwise ranking: what it learns from labels, and the quantile cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm.ranking import features, fit, keep_best, preferences, scored, train


def test_held_out_accuracy(spark):
    """Of pairs that the model was not fitted on, it prefers the better document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    good = preferences(labels)
    chosen = good.where("doc_id % 2 = 0")
    held = scored(docs, train(docs, chosen)).join(good.where("doc_id % 2 = 1"), "doc_id").collect()
    yes, no = (np.array([r["score"] for r in held if r["good"] == g]) for g in (True, False))
    assert (yes[:, None] > no[None, :]).mean() > 0.9


def test_gradient_is_that_of_the_logistic_loss():
    """Fitting lowers the loss on the pairs: words that only one side has end up with its sign."""
    words = [["good", "both"]] * 20 + [["bad", "both"]] * 20
    flags = np.array([True] * 20 + [False] * 20)
    import loomdex.llm.ranking as r

    share, r.MAX_SHARE = r.MAX_SHARE, 1.0
    try:
        model = fit(pa.array(words, pa.list_(pa.string())), np.zeros((40, r.N_STYLE)), flags, pairs=500, rounds=100)
    finally:
        r.MAX_SHARE = share
    assert model.words["good"] > 0 > model.words["bad"] and "both" not in model.words
    assert model.score("good") > model.score("bad")


def test_words_of_a_small_language_count():
    """A word that only five training documents have, all bad, lowers the score; one seen once hardly does."""
    words = [["dull"] * (i % 9 == 0) + [f"w{i}"] for i in range(300)] + [["vile", f"x{i}"] for i in range(5)] + [["rude", f"y{i}"] for i in range(95)]
    flags = np.array([True] * 300 + [False] * 100)
    model = fit(pa.array(words, pa.list_(pa.string())), np.zeros((400, 8)), flags, pairs=4000, rounds=200)
    assert model.score("vile") < -1 and abs(model.score("w1")) < 0.1 * abs(model.score("vile"))


def test_without_pairs_all_scores_are_zero():
    model = fit(pa.array([["a"]] * 3, pa.list_(pa.string())), np.zeros((3, 8)), np.array([True] * 3))
    assert model.score("anything at all") == 0.0
    empty = fit(pa.array([], pa.list_(pa.string())), np.zeros((0, 8)), np.zeros(0, bool))
    assert empty.score(None) == 0.0 and features(None)[0] == set()


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, ("clear prose about harbours and letters " if i % 2 else "click win free prize now ") * (1 + i % 5), "en", 0.5) for i in range(200)]
    rows += [(300, None, "en", 0.5), (301, "", None, None), (302, "clear prose about harbours and letters " * 30_000, "en", 0.1), (1, rows[1][1], "en", 0.5), (None, "clear prose", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(0, 160)] + [(1, 1, None, "x"), (None, 1, 0, "x"), (9999, 1, 0, "x"), (4, None, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    return docs, labels


def test_table_cases(spark, tables):
    docs, labels = tables
    every = keep_best(docs, labels, quantile=0.0)
    assert every.columns == ["doc_id", "score"] and every.count() == docs.count()
    score = {r["doc_id"]: r["score"] for r in every.collect()}
    assert min(score[i] for i in range(1, 200, 2)) > max(score[i] for i in range(0, 200, 2))
    half = keep_best(docs, labels, quantile=0.5).collect()
    assert len([r for r in half if r["doc_id"] == 1]) == 2  # repeated rows are judged alike
    cut = sorted(r["score"] for r in every.collect())[(docs.count() - 1) // 2]
    assert min(r["score"] for r in half) == cut  # rows at the threshold stay
    kept = {r["doc_id"] for r in keep_best(docs, labels).collect()}
    assert set(range(161, 200, 2)) <= kept and not kept & set(range(0, 200, 2))
    assert keep_best(docs.limit(0), labels).count() == 0
    assert keep_best(docs, labels.limit(0)).count() == docs.count()
    assert keep_best(docs, labels.where("quality = 1")).count() == docs.count()


def test_the_worst_label_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")
    assert {r["doc_id"]: r["good"] for r in preferences(labels).collect()} == {1: False, 2: True, 3: False, 4: True}
