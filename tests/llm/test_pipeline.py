"""The corpus pipeline, stage by stage, against brute-force versions of its stages."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from test_mixing import model
from test_neardup import brute as groups
from test_repetition import brute as repeats

import corpus_pipeline
from loomdex.llm.mixing import SLOTS
from loomdex.llm.pretokens import VOCABULARY, encoding
from loomdex.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT
from loomdex.llm.tokens import end_id

STAGES = dict(corpus_pipeline.STAGES)


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(24):
        text = _prose(rng, 40)
        if i % 6 == 1:
            text = (text[:80] + "\n") * 4
        if i % 6 == 2:
            text += f" mail to user{i}@example.org soon"
        rows.append((i, text, "en", ["hot", "hot", "cold"][i % 3], len(text), "x"))
    rows += [(100 + i, rows[i][1] + " indeed", "en", "hot", len(rows[i][1]) + 7, "y") for i in (0, 2, 3)]
    rows += [(200, None, "en", "hot", None, "z"), (201, "", None, None, 0, "z"), (202, _prose(rng, 40), "en", None, 1, None), (0, *rows[0][1:])]
    where = f"{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `slot` string").write.parquet(f"{where}/documents.parquet")
    return where


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), [None]
    out[0] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        out.append(docs)
    return out


def _rows(df):
    return Counter(map(tuple, df.collect()))


def _pieces(windows):
    return Counter((p["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u2")[p["offset"] : p["offset"] + p["n_tokens"] - 1].tolist())) for r in windows.collect() for p in r["pieces"])


def test_columns(outputs):
    assert 4 <= len(STAGES) <= 5
    assert all(df.columns == outputs[0].columns for df in outputs[:-1])


def test_quality_rules(outputs):
    def keeps(text):
        n, covered, longest = repeats(text, MIN_REPEAT)
        return covered <= MAX_COVERED * n and longest <= MAX_LONGEST

    want = Counter(tuple(r) for r in outputs[0].collect() if keeps(r["text"]))
    assert _rows(outputs[1]) == want and sum(want.values()) < outputs[0].count()


def test_near_dedup(outputs):
    rows = outputs[1].collect()
    _, group = groups([(r["doc_id"], r["text"]) for r in rows])
    want = {tuple(r) for r in rows if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"]}
    assert _rows(outputs[2]) == Counter(want) and len(want) < len(rows)


def test_pii(outputs):
    want = Counter()
    for r in outputs[2].collect():
        text = r["text"]
        mail = f"user{r['doc_id']}@example.org"
        if text and mail in text:
            text = text.replace(mail, "<EMAIL>")
        want[(r["doc_id"], text, r["lang"], r["source"], None if text is None else len(text), r["slot"])] += 1
    assert _rows(outputs[3]) == want and any("<EMAIL>" in (k[1] or "") for k in want)


def test_mixing(outputs):
    got = Counter((r["doc_id"], r["text"]) for r in outputs[4].collect())
    assert got == Counter((d, t) for row in model(outputs[3], corpus_pipeline.PIECE, SLOTS) for d, _, t in row[5])


def test_packing(outputs):
    """The windows alone give back the tokens of every piece that was drawn, as often as it was."""
    encode = encoding(VOCABULARY).encode_ordinary
    want = Counter((r["doc_id"], tuple(encode(r["text"]))) for r in outputs[4].collect())
    got = Counter()
    for r in outputs[5].collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
        assert len(ids) == r["n_tokens"] <= r["window_tokens"] == min(w for w in (2048, 8192, 32768) if w >= r["window_tokens"])
        for p in r["pieces"]:
            own = tuple(ids[p["offset"] : p["offset"] + p["n_tokens"]])
            assert p["start"] == 0 and own[-1] == end_id() and end_id() not in own[:-1]  # pieces fit a window
            got[p["doc_id"], own[:-1]] += 1
    assert got == want == _pieces(outputs[5])


def test_run(spark, sf, outputs):
    assert _pieces(corpus_pipeline.run(spark, sf)) == _pieces(outputs[5])


def test_an_empty_table(spark, tmp_path, outputs):
    outputs[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
