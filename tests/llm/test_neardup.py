"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from loomdex.llm import common, neardup
from loomdex.llm import components as components_
from loomdex.llm.components import components
from loomdex.llm.neardup import drop_near_duplicates, near_duplicates


def _sets(rows):
    out = {}
    for i, t in rows:
        words = re.sub(r"[぀-龿々฀-໿က-႟ក-៿\U00020000-\U000323af]", r" \g<0> ", (t or "").lower())
        words = [w for w in re.split(r"[\x00-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", words) if w]
        if i is not None and words:
            out[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return out


def _union(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, threshold=neardup.THRESHOLD):
    sets = _sets(rows)
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    groups, sizes = _union(ids, edges), {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    return edges, {d: g for d, g in groups.items() if sizes[g] > 1}


def _text(rng, n=80):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, k = [], 0
    for _ in range(40):
        base = _text(rng)
        for c in range(rng.choice([1, 1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark, corpus):
    _, want = brute(corpus)
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(corpus, "doc_id bigint, text string")).collect()}
    assert got == want


def test_recall_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edges, want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(docs).collect()}
    found = sum(a in got and got[a] == got.get(b) for a, b in edges)
    assert found >= 0.9 * len(edges)
    for d, g in got.items():  # nothing is grouped that brute force keeps apart
        assert want[d] == want[g]


def test_a_chain_around_one_bucket(spark):
    """Members of a bucket that only each other, not its least document, resemble."""
    rng = random.Random(9)
    base, other = _text(rng, 60), _text(rng, 60)
    half = base[:30] + other[:30]
    rows = [(1, " ".join(base)), (2, " ".join(half)), (3, " ".join(half[:-1] + ["z"])), (4, " ".join(base[:-1] + ["y"]))]
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 4: 1, 2: 2, 3: 2}


def test_table_cases(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [
        (5, "one two three four five", "k"), (3, "One Two  three four FIVE", "k"), (9, None, "k"), (8, "", "k"), (7, " \n ", "k"), (6, "", "k"), (None, "one two three four five", "k"),
        (1, "two words", "k"), (2, "two words", "k"), (5, "one two three four five", "k"), (10, long, "k"), (11, long + " more", None), (12, "alone here and nowhere else", "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, group_id string")
    got = {(r["doc_id"], r["group_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(3, 3), (5, 3), (1, 1), (2, 1), (10, 10), (11, 10)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 9, 8, 7, 6, None, 1, 10, 12], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_scripts_without_spaces(spark):
    """Near copies of texts without spaces are found, and white space of any kind separates words."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = [chr(rng.randrange(0x4E00, 0x9FA5)) if k % 2 else chr(rng.randrange(0xE01, 0xE2E)) for _ in range(120)]
        other = [*base[:60], "新", *base[61:]]
        rows += [(3 * k, "".join(base)), (3 * k + 1, "".join(other)), (3 * k + 2, "\u3000".join(base))]
    rows += [(100, "one\xa0two\u2009three four five six"), (101, "one two three four\u3000five six"), (102, "漢字かなabc\U00020000x, and so on"), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, want = brute(rows)
    assert {r["doc_id"]: r["group_id"] for r in near_duplicates(docs).collect()} == want and want[1] == want[2] == 0 and want[101] == 100


def test_heavy_groups(spark, corpus, monkeypatch):
    """Groups of copies, buckets and nodes that are too much for one task give the same groups."""
    rng = random.Random(6)
    base = _text(rng)
    rows = corpus + [(10_000 + i, " ".join(base)) for i in range(150)] + [(20_000 + i, " ".join([*base[:70], f"v{i}", *base[71:]])) for i in range(60)]
    rows += [(5, "zz another text of this id, which is the greater one")] + [(30_000, "zz another text of this id, which is the greater one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "HEAVY_ROWS", 40)
    monkeypatch.setattr(components_, "HEAVY_ROWS", 40)
    assert common.heavy_keys(docs.selectExpr("doc_id div 10000 as k"), "k")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want
    groups = dict(want)
    assert groups[5] == groups[30_000] == 5 and groups[10_000] == groups[20_059]


def test_a_repeated_id_stays_once(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "quite another text")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (7, 9), (9, 7)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == _union(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
