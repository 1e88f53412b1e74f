"""The mixture against a plain model of it."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm import mixing
from loomdex.llm.mixing import mix_documents, mixed_blocks, permute, positions, slot_plan, target_weights
from loomdex.llm.pretokens import VOCABULARY, encoding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tokens(text):
    return encoding(VOCABULARY).encode_ordinary(text or "")


def texts_of(parts):
    """Texts of [ids] of one document after another: what begins inside a character belongs to the part before."""
    raw, out = [encoding(VOCABULARY).decode_bytes(p) for p in parts], []
    whole = b"".join(raw)
    ends = np.cumsum([len(r) for r in raw]).tolist()
    for k, e in enumerate(ends):
        while e < len(whole) and whole[e] & 0xC0 == 0x80:
            e += 1
        ends[k] = e
    return [whole[a:b].decode() for a, b in zip([0, *ends], ends)]


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        words = [f"d{i}w{j}é" for j in range(int(rng.integers(1, 90)))]
        text = "  \n"[: i % 3] + "".join(w + (" " if j % 7 else "\n\n") for j, w in enumerate(words))
        rows.append((i, text, "en", ["big", "big", "big", "mid", None][i % 5], len(text)))
    rows += [(100, None, "en", "big", None), (101, "", "en", "big", 0), (102, " \n", "en", "mid", 2), (None, "words without an id", "en", "mid", 10), (0, *rows[0][1:])]
    rows += [(103, "漢字仮名交じり文" * 30 + "\U0001f600" * 20, "ja", "mid", 260)]
    return spark.createDataFrame(rows, SCHEMA)


def stored(docs):
    """(first, name, row number, text) of each document with tokens: where it begins in its source."""
    where, _ = positions(docs, F.struct("doc_id", "text"))
    return [(r["first"], r["name"], r["carried"]["doc_id"], r["carried"]["text"], np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in where.collect()]


def model(docs, block, slots, weights=None, seed=mixing.SEED):
    """Rows (shard, slot, source, pass, block, ((doc_id, ids, text), ...)) by loops over everything."""
    want = Counter((r["source"] or "", r["doc_id"], r["text"]) for r in docs.collect() if tokens(r["text"]))
    rows = sorted(stored(docs), key=lambda r: r[:2])
    assert Counter((r[1], r[2], r[3]) for r in rows) == want and all(r[4] == tokens(r[3]) for r in rows)
    blocks, totals = defaultdict(list), Counter()
    for first, name, doc_id, text, ids in rows:
        assert first == totals[name]
        at, cuts = 0, []
        while at < len(ids):
            n = min(len(ids) - at, block - (first + at) % block)
            cuts.append((first + at, ids[at : at + n]))
            at += n
        for (start, own), t in zip(cuts, texts_of([c[1] for c in cuts])):
            if start % block == 0:
                blocks[name].append([])
            blocks[name][-1].append((doc_id, tuple(own), t))
        totals[name] += len(ids)
    names = sorted(totals)
    p = target_weights(totals, weights)
    left, taken, out, shard = sum(map(len, blocks.values())), Counter(), [], 0
    while left:
        rng = np.random.default_rng([seed, shard])
        k = min(slots, left)
        counts = rng.multinomial(k, [p[n] for n in names])
        for slot, s in enumerate(rng.permutation(np.repeat(np.arange(len(names)), counts))):
            n, at = len(blocks[names[s]]), taken[s]
            taken[s] += 1
            turn = at // n
            b = int(permute(np.array([at % n]), np.array([n]), np.array([s * 1_000_003 + turn * 7919 + seed]))[0])
            out.append((shard, slot, names[s], turn, b, tuple(blocks[names[s]][b])))
        left -= k
        shard += 1
    return out


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "mid": 3.0}, {"": 1.0}])
def test_equals_the_model(docs, weights):
    got = sorted((r["shard"], r["slot"], r["source"], r["pass"], r["block"], tuple(r["doc_ids"]), np.frombuffer(bytes(r["ids"]), "<u2").tolist(), r["n_tokens"]) for r in mixed_blocks(docs, weights, 32, 8).collect())
    want = sorted((*row[:5], tuple(d for d, _, _ in row[5]), [i for _, ids, _ in row[5] for i in ids], sum(len(ids) for _, ids, _ in row[5])) for row in model(docs, 32, 8, weights))
    assert got == want


@pytest.mark.parametrize("block", [1, 32, 4096])
def test_pieces_of_documents(docs, block):
    rows = mix_documents(docs, block=block, slots=8)
    assert rows.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in rows.collect())
    assert got == Counter((d, t) for row in model(docs, block, 8) for d, _, t in row[5] if t)
    assert all(r["n_chars"] == len(r["text"]) for r in rows.collect())


def test_unspaced_scripts_make_whole_blocks(spark):
    """Texts without spaces are cut into blocks of the very size, and so weigh what they hold."""
    docs = spark.createDataFrame([(i, "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 40, "zh" if i % 2 else "other") for i in range(30)], "doc_id bigint, text string, source string")
    rows = mixed_blocks(docs, block=256, slots=16).collect()
    last = {s: -(-sum(len(tokens("天地玄黄宇宙洪荒日月盈昃辰宿列张" * 40)) for _ in range(15)) // 256) - 1 for s in ("zh", "other")}
    assert len(rows) > 100 and all(r["n_tokens"] == 256 for r in rows if r["block"] != last[r["source"]])


def test_a_source_of_one_document_is_spread(spark, monkeypatch):
    """Half of all slots are of one block: its copies are as many as its passes ask for, and no row is lost."""
    monkeypatch.setattr(mixing, "PASSES", 4)
    docs = spark.createDataFrame([(i, f"w{i} " * 50, "big") for i in range(60)] + [(100, "one only", "small")], "doc_id bigint, text string, source string")
    rows = mixed_blocks(docs, {"big": 1.0, "small": 1.0}, 8, 16)
    got = [r for r in rows.collect() if r["source"] == "small"]
    assert rows.count() > 500 and len(got) > 200 and {tuple(r["doc_ids"]) for r in got} == {(100,)} and len({r["pass"] for r in got}) == len(got)


def _plan(docs, *args, **kw):
    totals = Counter()
    for _, name, _, _, ids in stored(docs):
        totals[name] += len(ids)
    return slot_plan(dict(totals), docs.sparkSession, *args, **kw)


def test_every_pass_has_every_block(docs):
    used = defaultdict(list)
    plan, passes = _plan(docs, {"mid": 1.0}, 16, 8)
    for r in plan.collect():
        used[r["name"], r["pass"]].append(r["block"])
    sizes = {p: sorted(b) for (_, p), b in used.items()}
    assert len(sizes) > 2 and all(len(set(b)) == len(b) for b in sizes.values())
    assert all(b == list(range(len(sizes[0]))) for p, b in sizes.items() if p < max(sizes))
    assert passes == {"mid": len(sizes)}


def test_many_shards_count_on(docs, monkeypatch):
    """Running counts by chunks of shards are those of all shards."""
    want = sorted(map(tuple, _plan(docs, None, 4, 2)[0].collect()))
    monkeypatch.setattr(mixing, "CHUNK_SHARDS", 3)
    assert sorted(map(tuple, _plan(docs, None, 4, 2)[0].collect())) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(permute(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_weights():
    assert target_weights({"a": 100, "b": 100}, None) == {"a": 0.5, "b": 0.5}
    assert target_weights({"a": 1, "b": 1}, {"a": 3.0}) == {"a": 1.0, "b": 0.0}
    for bad in ({"a": -1.0}, {"c": 1.0}):
        with pytest.raises(ValueError):
            target_weights({"a": 1}, bad)


def test_table_cases(spark, docs):
    assert mixed_blocks(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).columns == docs.columns and mix_documents(docs.limit(0)).count() == 0
    long = "word " * 20_000
    clash = spark.createDataFrame([(1, long, "x", 1, "own"), (2, "tie", "x", 2, "own"), (3, "tie", "x", 2, "own"), (3, "tie", "x", 2, "own"), (None, "tie", None, None, None)], "doc_id bigint, text string, `slot` string, `ids` int, `name` string")
    rows = mix_documents(clash, block=2048, slots=4)
    assert rows.columns == clash.columns and [f.dataType for f in rows.schema] == [f.dataType for f in clash.schema]
    got = rows.collect()
    assert sum(len(r["text"]) for r in got) == len(long) + 12 and Counter(r["doc_id"] for r in got if r["text"] == "tie") == {2: 1, 3: 2, None: 1}
    assert {r["doc_id"] for r in mixed_blocks(clash).selectExpr("explode(doc_ids) as doc_id").collect()} == {1, 2, 3, None}
