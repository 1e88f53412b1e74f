"""The retrieval operators on small tables, against plain Python and by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators import fusion, lexical, metrics, segments, sets, vectors
from loomdex.plans import queries, search
from loomdex.plans.oracles import ORACLE_SQL
from loomdex.sources.index import StoredIndex, check_events
from loomdex.sources.storage import tasks
from loomdex.streaming.ingest import SearchCluster, StreamIndexer

DOCS = "segment int, doc_id bigint, terms array<string>"
ASKED = "query_id int, lexical_terms array<string>, top_k int"


def _docs(spark, terms: dict[int, list[str]]):
    return spark.createDataFrame([(0, d, t) for d, t in terms.items()], DOCS)


def _search(spark, docs, terms, k=10, tokens=None):
    asked = spark.createDataFrame([(1, terms, k)], ASKED)
    if tokens is not None:
        asked = asked.withColumn("tokens", F.array(*map(F.lit, tokens)).cast("array<string>"))
    return [(r["doc_id"], r["score"]) for r in lexical.search_and(lexical.postings(docs), asked).orderBy("rank").collect()]


def _bm25(terms, query, k1=1.2, b=0.75):
    n, avg = len(terms), sum(map(len, terms.values())) / len(terms)
    out = {}
    for d, ts in terms.items():
        if all(q in ts for q in query):
            score = np.float32(0)
            for q in query:
                df, tf = sum(q in t for t in terms.values()), ts.count(q)
                norm = k1 * (1 - b) + k1 * b * len(ts) / avg
                score += np.float32(math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm))
            out[d] = float(score)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


FOUR = {0: ["cisco", "router"], 1: ["cisco"], 2: ["router"], 3: ["cisco", "router", "config"]}


def test_conjunction(spark):
    assert {d for d, _ in _search(spark, _docs(spark, FOUR), ["cisco", "router"])} == {0, 3}
    assert _search(spark, _docs(spark, {0: ["cisco"]}), ["cisco", "notpresent"]) == []


def test_bm25_against_plain_python(spark):
    rng = random.Random(0)
    terms = {d: [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))] for d in range(200)}
    docs = _docs(spark, terms)
    for query in (["a"], ["a", "b"], ["c", "c"], ["a", "b", "c", "d", "e"]):
        got, want = _search(spark, docs, query, 20), _bm25(terms, query)[:20]
        assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_rare_term_among_many(spark):
    docs = _docs(spark, {d: ["common", f"rare{d}"] for d in range(500)})
    assert [d for d, _ in _search(spark, docs, ["common", "rare42"])] == [42]


def test_access_comes_after_statistics(spark):
    docs = _docs(spark, {d: ["cisco", "_acl_read:all" if d == 1 else "_acl_read:some", "_acl_read:other"] for d in range(3)})
    every, some = _search(spark, docs, ["cisco"]), _search(spark, docs, ["cisco"], tokens=["some", "nobody"])
    assert [d for d, _ in every] == [0, 1, 2] and some == [every[0], every[2]]
    assert _search(spark, docs, ["cisco"], tokens=["some", "other"]) == every  # two grants are as good as one
    assert _search(spark, docs, ["cisco"], tokens=[]) == _search(spark, docs, ["cisco"], tokens=["cisco"]) == []


def test_bad_documents_are_refused(spark):
    for bad in ([(0, -1, ["a"])], [(0, None, ["a"])], [(0, 1, ["a", ""])]):
        with pytest.raises(Exception, match="a document needs"):
            lexical.postings(spark.createDataFrame(bad, DOCS)).collect()


def test_long_lists_are_numbered_in_chunks(spark, monkeypatch):
    """Terms of more documents than one task should have give the same postings and blocks."""
    docs = _docs(spark, {d * 7: ["hot", f"t{d % 5}", *(["twice"] * 2)] for d in range(700)})
    posted, cut = (sorted(map(tuple, x.collect())) for x in (lexical.postings(docs), lexical.blocks(lexical.postings(docs))))
    monkeypatch.setattr(lexical, "CHUNK_IDS", 500)
    monkeypatch.setattr(lexical, "HOT", 100)
    assert sorted(map(tuple, lexical.postings(docs).collect())) == posted
    assert sorted(map(tuple, lexical.blocks(lexical.postings(docs), hot=100).collect())) == cut


@pytest.mark.parametrize("seed", range(3))
def test_pruned_search(spark, seed):
    """Reading only what the blocks leave open gives the same rows, ties and short lists among them."""
    rng = random.Random(seed)
    docs = _docs(spark, {d: [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] for d in range(900)})
    asked = spark.createDataFrame([(1, ["a"], 3), (2, ["a", "b"], 10), (3, ["c", "c", "d"], 5), (4, ["a", "nowhere"], 5), (5, ["h", "g", "f", "e"], 500)], ASKED)
    posted = lexical.postings(docs)
    want = sorted(map(tuple, lexical.search_and(posted, asked).collect()))
    got = lexical.search_pruned(posted, lexical.blocks(posted, 16), asked, 32)
    assert sorted(map(tuple, got.collect())) == want


def test_statistics(spark):
    docs = _docs(spark, {0: ["cisco", "router"], 1: ["cisco", "switch"], 2: ["juniper", "router"]})
    df = {r["term"]: r["df"] for r in lexical.term_stats(lexical.term_frequency(docs)).collect()}
    assert df == {"cisco": 2, "router": 2, "switch": 1, "juniper": 1}
    assert tuple(lexical.segment_stats(_docs(spark, {0: ["a", "b", "c"], 1: ["a"]})).select("n_docs", "avg_len").first()) == (2, 2.0)


def test_blocks_and_seeks(spark):
    posted = lexical.postings(_docs(spark, {d: ["t"] for d in range(300)}))
    assert [r["n"] for r in lexical.blocks(posted).orderBy("block_no").collect()] == [128, 128, 44]
    widths = lexical.blocks(lexical.postings(_docs(spark, {5: ["t"]}))).collect()
    assert [r["bit_width"] for r in widths] == [1]
    few = lexical.postings(_docs(spark, {d: ["t"] for d in (1, 5, 9, 12, 20)}))
    ask = spark.createDataFrame([("t", 10), ("t", 15), ("t", 21), ("u", 0)], "term string, target bigint")
    assert {r["target"]: r["doc_id"] for r in lexical.seek(few, ask).collect()} == {10: 12, 15: 20, 21: None, 0: None}
    assert lexical.past_block(posted, spark.createDataFrame([("t", 0)], "term string, target bigint")).first()["doc_id"] == 128
    best = {r["block_no"]: r["max_impact"] for r in lexical.blocks(posted).collect()}
    assert lexical.can_contribute(lexical.blocks(posted), max(best.values())).count() == 0
    assert lexical.can_contribute(lexical.blocks(posted), 0.0).count() == 3


def test_dictionary(spark, monkeypatch):
    docs = _docs(spark, {0: ["cisco", "circuit"], 1: ["cisco-router", "cisco"], 70_000: ["router", "alpha"], 200_000: ["beta", "router"]})
    want = {"circuit": 0, "cisco": 1, "cisco-router": 2, "alpha": 3, "router": 4, "beta": 5}
    assert {r["term"]: r["ordinal"] for r in lexical.dictionary(docs).collect()} == want
    terms = spark.createDataFrame([(t,) for t in want], "term string")
    assert [r["term"] for r in lexical.with_prefix(terms, "cisco").collect()] == ["cisco", "cisco-router"]
    with pytest.raises(ValueError):
        lexical.with_prefix(terms, "")


def test_bm25_parameters(spark):
    def impact(df, tf, length):
        return spark.range(1).select(X.bm25(F.lit(1_000_000), F.lit(df), F.lit(tf), F.lit(length), F.lit(100.0)).alias("x")).first()["x"]

    assert impact(100, 1, 100) > impact(1000, 1, 100) > impact(100_000, 1, 100) > 0
    assert impact(100, 1, 100) < impact(100, 10, 100) < impact(100, 100, 100) < 50 * impact(100, 1, 100)
    assert impact(100, 1, 50) > impact(100, 1, 100) > impact(100, 1, 500)
    for bad in ({"k1": 0}, {"b": 1.5}):
        with pytest.raises(ValueError):
            X.bm25(F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1.0), **bad)


def test_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    of = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert of(sets.union_ids(ids(1, 2), ids(2, 3))) == [1, 2, 3]
    assert of(sets.intersect_ids(ids(1, 2, 3), ids(2, 3, 4))) == [2, 3]
    assert of(sets.subtract_ids(ids(1, 2, 3), ids(2))) == [1, 3]
    many = ids(500_000, 42, 0, 100, 65_535, 65_536, 999_999, 42)
    assert sets.cardinality(many).first()["cardinality"] == 7
    assert {r["chunk_key"]: r["cardinality"] for r in sets.chunks(many).collect()} == {0: 4, 1: 1, 7: 1, 15: 1}
    assert {r["doc_id"]: r["present"] for r in sets.contains(many, ids(42, 43, -1)).collect()} == {42: True, 43: False, -1: False}
    assert sets.cardinality(many.limit(0)).first()["cardinality"] == 0
    assert of(sets.live(ids(1, 2, 3), ids(2, 9))) == [1, 3]
    assert of(sets.add_ids(ids(1, 2), ids(2, 3))) == [1, 2, 3]
    with pytest.raises(Exception, match="0 or more"):
        sets.add_ids(ids(1), ids(-1)).collect()
    assert [tuple(r) for r in sets.ascending(ids(65_536, 65_535, 3, 3)).collect()] == [(3, 0, 3), (65_535, 0, 65_535), (65_536, 1, 0)]


def test_floor(spark):
    asked = spark.createDataFrame([(1, 2), (2, 2)], "query_id int, top_k int")
    ranked = spark.createDataFrame([(1, 10.0, 1), (1, 5.0, 2), (1, 3.0, 3), (2, 4.0, 1)], "query_id int, score double, rank int")
    assert {r["query_id"]: r["floor"] for r in lexical.floors(ranked, asked).collect()} == {1: 5.0, 2: float("-inf")}


def test_access_filter(spark):
    docs = _docs(spark, {0: ["x", "_acl_read:user_42"], 1: ["_acl_read:group_admins"], 2: ["_acl_read:group_others"], 3: ["user_42"]})
    who = spark.createDataFrame([(1, "42", ["group_admins"]), (2, "9", []), (3, "42", None)], "query_id int, user_id string, acl_tokens array<string>")
    want = {(1, 0), (1, 1), (3, 0)}
    assert {tuple(r) for r in sets.readable(docs, who).collect()} == want
    assert {tuple(r) for r in sets.readable_postings(lexical.postings(docs), who).collect()} == want


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id int, doc_id bigint, rank int") for ids in ([1, 2, 3], [2, 1, 4])]
    got = [(r["doc_id"], r["score"]) for r in fusion.fuse(lists, ["query_id"]).orderBy("rank").collect()]
    assert [d for d, _ in got] == [1, 2, 3, 4] and got[0][1] == 1 / 61 + 1 / 62 and got[2][1] == 1 / 63
    assert fusion.fuse(lists, ["query_id"], 2).count() == 2
    with pytest.raises(ValueError):
        X.rrf(F.array(F.lit(1)), 0)


def test_late_interaction(spark):
    asked = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], 10)], "query_id int, colbert_tokens array<array<float>>, top_k int")
    tokens = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, []), (4, [[0.5, float("nan")], [0.5, 0.5]])], "doc_id bigint, colbert_tokens array<array<float>>")
    hits = spark.createDataFrame([(1, d) for d in (1, 2, 3, 4)], "query_id int, doc_id bigint")
    got = {r["doc_id"]: (r["score"], r["rank"]) for r in fusion.rerank(hits, asked, tokens, ["query_id"]).collect()}
    assert got == {1: (2.0, 1), 4: (1.0, 2), 2: (0.0, 3), 3: (0.0, 4)}
    assert fusion.rerank(hits, asked.withColumn("top_k", F.lit(1)), tokens, ["query_id"]).count() == 1
    other = spark.createDataFrame([(1, [[1.0, 0.0, 0.0]])], "doc_id bigint, colbert_tokens array<array<float>>")
    with pytest.raises(Exception, match="differ in length"):
        fusion.rerank(hits, asked, other, ["query_id"]).collect()


@pytest.fixture(scope="module")
def embedded(spark):
    v = np.random.default_rng(1).normal(size=(300, 16)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")


def test_product_quantisation(spark, embedded):
    v, rows = embedded
    book = vectors.collect_codebook(vectors.codebook(rows, 4, 8))
    assert book.shape == (4, 8, 4)
    codes = {r["vec_id"]: r["c"] for r in rows.select("vec_id", vectors.encode(F.col("embedding"), book).alias("c")).collect()}
    want = ((v.reshape(-1, 4, 1, 4) - book[None]).astype(float) ** 2).sum(3).argmin(2)
    assert all(codes[i] == want[i].tolist() for i in codes)
    lut = rows.where("vec_id = 7").select(F.lit(1).alias("query_id"), vectors.distance_table(F.col("embedding"), book).alias("lut"), F.lit(5).alias("top_k"))
    coded = rows.select(F.lit(0).alias("segment"), F.col("vec_id").alias("doc_id"), vectors.encode(F.col("embedding"), book).alias("code"))
    got = [(r["doc_id"], r["score"]) for r in vectors.search(coded, lut, m=4, n_centroids=8).orderBy("rank").collect()]
    table = ((v[7].reshape(4, 1, 4) - book).astype(float) ** 2).sum(2).astype(np.float32)
    dist = [sum((table[j, c] for j, c in enumerate(want[i])), np.float32(0)) for i in range(300)]
    assert [d for d, _ in got] == sorted(range(300), key=lambda i: (dist[i], i))[:5]
    for bad in ((10, 3, 8), (16, 4, 0), (16, 4, 300), (16, 0, 4)):
        with pytest.raises(ValueError):
            vectors.check_shape(*bad)
    with pytest.raises(ValueError):
        vectors.codebook(rows.limit(3), 4, 8)
    apart = vectors.collect_codebook(vectors.codebook(rows.selectExpr("vec_id * 10 + 3 as vec_id", "embedding"), 4, 8))  # ids need not be dense
    parts = v.reshape(300, 4, 4)
    for b in (book, apart):
        assert b.shape == (4, 8, 4) and all(len({tuple(c) for c in b[j]}) == 8 and {tuple(c) for c in b[j]} <= {tuple(x) for x in parts[:, j]} for j in range(4))
    uneven = rows.union(spark.createDataFrame([(999, [1.0])], rows.schema))
    with pytest.raises(ValueError):
        vectors.codebook(uneven, 4, 8)
    with pytest.raises(ValueError):
        vectors.collect_codebook(vectors.codebook(rows, 4, 8).where("m <> 1 or k <> 3"))
    some = coded.withColumn("acl_tokens", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z"))))
    seen = [r["doc_id"] for r in vectors.search(some, lut.withColumn("tokens", F.array(F.lit("x"), F.lit("y"))), m=4, n_centroids=8).orderBy("rank").collect()]
    assert seen == [i for i in sorted(range(300), key=lambda i: (dist[i], i)) if i % 3 == 0][:5]
    with pytest.raises(Exception, match="vectors must have 16 elements"):
        spark.createDataFrame([([1.0, 2.0],)], "e array<float>").select(vectors.encode(F.col("e"), book)).collect()


def test_graph(spark, embedded):
    v, rows = embedded
    book = vectors.collect_codebook(vectors.codebook(rows, 4, 8))
    graph = vectors.Graph(book)
    assert graph.beam(v[0], 5) == []
    for i in range(200):
        graph.insert(i, v[i])
    exact = vectors._distances(v[:200], book)
    hits = 0
    for q in range(50):
        table = exact[q].astype(np.float32)
        dist = np.sort([sum(table[j, c] for j, c in enumerate(graph.codes[i])) for i in range(200)])
        found = graph.beam(v[q], 40)
        hits += sum(d <= dist[9] + 1e-5 for d, _ in found[:10])
    assert hits >= 0.8 * 500
    odd = {i for i in range(200) if i % 2}
    few = {i for i in range(200) if i % 10 == 0}
    assert {x for _, x in graph.beam(v[0], 30, odd)} <= odd and graph.beam(v[0], 30, odd)
    assert {x for _, x in graph.beam(v[0], 30, few)} <= few and graph.beam(v[0], 30, few)
    with pytest.raises(ValueError):
        vectors.Graph(book, 1)


def test_router(spark):
    def mix(x):
        x &= 0xFFFFFFFF
        x = ((x ^ (x >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
        x = ((x ^ (x >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
        x ^= x >> 16
        return x - (1 << 32) if x >= 1 << 31 else x

    got = {r["id"]: r["s"] for r in spark.range(10_000).select("id", X.shard_of(F.col("id"), 8).alias("s")).collect()}
    assert all(s == mix(i) % 8 for i, s in got.items())
    assert all(875 <= n <= 1625 for n in Counter(got.values()).values()) and len(set(got.values())) == 8
    with pytest.raises(ValueError):
        X.shard_of(F.lit(1), 0)


def test_merge_selection(spark):
    def pick(rows, ratio=0.2, factor=3):
        df = spark.createDataFrame([(0, i, n, float(r)) for i, (n, r) in enumerate(rows)], "g int, position int, live_docs int, tombstone_ratio double")
        return [r["position"] for r in segments.pick_merge(df, ["g"], ratio, factor).orderBy("pick").collect()]

    assert pick([(40, 0), (10, 0), (30, 0), (20, 0)]) == [1, 3, 2]
    assert pick([(100, 0), (6, 0.4)], 0.3) == [1, 0]
    assert pick([(10, 0), (20, 0)]) == []
    assert pick([(5, 0.5)]) == [0]
    for bad in ((-0.1, 3), (0.2, 1)):
        with pytest.raises(ValueError):
            pick([(1, 0)], *bad)


def test_segments(spark, monkeypatch):
    ids = spark.range(20).withColumnRenamed("id", "doc_id")
    docs = segments.assign(ids, 1, 10).drop("seq")
    tombs = spark.createDataFrame([(0, 0), (0, 1), (0, 0), (0, 77), (1, 88)], "segment_no int, doc_id bigint")
    built = spark.createDataFrame([(1, 15)], "segment_no int, doc_id bigint")
    got = {r["segment_no"]: (r["n_docs"], r["n_tombstones"], r["tombstone_ratio"], r["live_docs"]) for r in segments.stats(docs, tombs, ["segment_no"], built).collect()}
    assert got == {0: (10, 3, 0.3, 10), 1: (10, 1, 0.1, 9)}  # ids that a segment lacks count; what was live at the build stays
    many = spark.createDataFrame([(0, 100 + i) for i in range(30)], "segment_no int, doc_id bigint")
    assert segments.stats(docs, many, ["segment_no"]).where("segment_no = 0").first()["tombstone_ratio"] == 3.0
    marks = segments.placed_tombstones(docs, spark.createDataFrame([(3,), (3,), (14,), (99,)], "doc_id bigint"), 1)
    assert sorted(tuple(r) for r in marks.collect()) == [(0, 0, 3), (0, 1, 14), (0, 1, 99)]
    dead = spark.createDataFrame([(0,), (1,), (0,), (77,)], "doc_id bigint")
    picked = spark.createDataFrame([(0, 0), (0, 1)], "shard int, segment_no int")
    out = segments.compact(docs.select("shard", "segment_no", "doc_id"), picked, dead, ["shard"], "segment_no").collect()
    assert {r["segment_no"] for r in out} == {0} and sorted(r["doc_id"] for r in out) == list(range(2, 20))
    want = sorted(map(tuple, segments.assign(ids, 3, 4).collect()))
    monkeypatch.setattr(segments, "CHUNK_IDS", 3)
    assert sorted(map(tuple, segments.assign(ids, 3, 4).collect())) == want


def test_tier(spark):
    rows = spark.createDataFrame([(10, 2), (100, 2), (10, 5), (50, 1), (49, 3)], "k int, n int")
    assert [r["t"] for r in rows.select(X.tier(F.col("k"), F.col("n")).alias("t")).collect()] == ["TIER1_ONLY", "BOTH", "BOTH", "BOTH", "TIER1_ONLY"]
    with pytest.raises(ValueError):
        X.tier(F.lit(1), F.lit(1), 0)


def test_metrics(spark):
    rng = random.Random(2)
    samples = {"one": [7.0], "many": [float(rng.randrange(1000)) for _ in range(2001)], "ties": [1.0] * 500 + [2.0] * 3}
    df = spark.createDataFrame([(n, v) for n, vs in samples.items() for v in vs] + [("none", None)], "name string, value double")
    ps = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["name"], r["p"]): r["value"] for r in metrics.percentiles(df, ps).collect()}
    assert got == {(n, p): sorted(vs)[math.floor(p * (len(vs) - 1))] for n, vs in samples.items() for p in ps} | {("none", p): 0.0 for p in ps}
    with pytest.raises(ValueError):
        metrics.percentiles(df, [1.5])
    deltas = spark.createDataFrame([("a", 1), ("a", None), ("a", 5), ("b", 2)], "name string, delta bigint")
    assert {r["name"]: r["value"] for r in metrics.counters(deltas).collect()} == {"a": 7, "b": 2}
    settings = spark.createDataFrame([("g", 1, 1), ("g", 9, 3), ("g", 4, 2)], "name string, value int, seq int")
    assert metrics.gauges(settings).first()["value"] == 9
    assert {r["name"]: r["n"] for r in metrics.histogram_counts(df).collect()} == {"one": 1, "many": 2001, "ties": 503, "none": 0}


@pytest.fixture(scope="module")
def cluster(spark, embedded):
    v, rows = embedded
    book = vectors.collect_codebook(vectors.codebook(rows, 8, 16))
    acl = F.array(F.when(F.col("vec_id") % 2 == 0, "group_even").otherwise("group_odd"))
    parts = F.array(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8))
    docs = rows.where("vec_id < 60").select(F.col("vec_id").alias("doc_id"), F.array(F.lit("shared"), F.concat(F.lit("t"), F.col("vec_id") % 3)).alias("content_terms"), acl.alias("acl_tokens"), F.concat(F.lit("p"), "vec_id").alias("payload"), "embedding", parts.alias("colbert_tokens"))
    asked = spark.createDataFrame(
        [(1, ["shared", "t1"], "u", ["group_even"], 8, v[3].tolist(), [v[3][:8].tolist()]), (2, ["nowhere"], "u", ["group_even", "group_odd"], 60, v[4].tolist(), [v[4][:8].tolist()]), (3, ["shared"], "u", [], 5, v[5].tolist(), [])],
        "query_id int, lexical_terms array<string>, user_id string, acl_tokens array<string>, top_k int, dense_vector array<float>, colbert_tokens array<array<float>>",
    )
    return docs, asked, book


def _hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_cluster_search(spark, cluster):
    docs, asked, book = cluster
    none = spark.createDataFrame([], "doc_id bigint")
    hits = _hits(search.cluster_search(docs, asked, none, book))
    assert len(hits[1]) == 8 and all(d % 2 == 0 for d in hits[1])
    assert sorted(hits[2]) == list(range(60))  # no term matches, but the vectors do
    assert 3 not in hits  # nothing may be read
    shards = {r["id"]: r["s"] for r in spark.range(60).select("id", X.shard_of(F.col("id"), 4).alias("s")).collect()}
    assert len({shards[d] for d in hits[2][:4]}) == 4  # the best of every shard come first
    gone = spark.createDataFrame([(d,) for d in range(60)], "doc_id bigint")
    assert search.cluster_search(docs, asked, gone, book).count() == 0
    some = _hits(search.cluster_search(docs, asked, gone.where("doc_id < 30"), book))
    assert all(d >= 30 for ids in some.values() for d in ids)
    with pytest.raises(ValueError):
        search.cluster_search(docs, asked.withColumn("top_k", F.lit(0)), none, book)


def test_deadline(spark, cluster):
    docs, asked, book = cluster
    none = spark.createDataFrame([], "doc_id bigint")
    rows, partial = search.search_with_deadline(spark, docs, asked, none, book, 300)
    want = [(r["query_id"], r["doc_id"], r["rank"]) for r in search.cluster_search(docs, asked, none, book).orderBy("query_id", "rank").collect()]
    assert not partial and [(q, d, r) for q, d, _, r in rows] == want
    rows, partial = search.search_with_deadline(spark, docs, asked, none, book, 0.0)
    assert partial and len(rows) < len(want)


def test_stored_index(spark, cluster, tmp_path):
    docs, asked, book = cluster
    none = spark.createDataFrame([], "doc_id bigint")
    index = StoredIndex(spark, f"file://{tmp_path}/index", book, 4)
    with pytest.raises(ValueError):
        index.visible("postings")
    index.delete(spark.createDataFrame([(3,)], "doc_id bigint"))  # nothing is flushed yet
    placed = search.segment_documents(docs, 4, 1000)
    index.flush(placed)
    want = search.cluster_search(docs, asked, none, book)
    assert sorted(search.stored_search(index, asked).collect()) == sorted(want.collect())
    newer = docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1000)
    index.flush(search.segment_documents(newer, 4, 1000).withColumn("segment_no", F.lit(1)))
    every, latest = (_hits(search.stored_search(index, asked, v))[2] for v in ("all", "latest"))
    routed = {r["doc_id"]: r["s"] for r in docs.select("doc_id").union(newer.select("doc_id")).select("doc_id", X.shard_of(F.col("doc_id"), 4).alias("s")).collect()}
    replaced = {routed[d] for d in routed if d >= 1000}
    assert len(every) == 60 and set(latest) == {d for d in routed if d >= 1000 or routed[d] not in replaced}
    assert {r["payload"] for r in index.fetch(spark.createDataFrame([(3,)], "doc_id bigint")).collect()} == {"p3"}
    assert index.visible("blocks").agg(F.sum("n")).first()[0] == index.visible("postings").count()
    with pytest.raises(ValueError):
        index.listed("other")


def test_deletes_and_merges(spark, cluster, tmp_path):
    """A delete hides a document up to its shard's last segment; a merge makes it so without the delete, and a document
    that comes again is there again."""
    docs, asked, book = cluster
    asked = asked.where("query_id = 2").withColumn("top_k", F.lit(100))
    index = StoredIndex(spark, f"file://{tmp_path}/index", book, 2)
    index.flush(search.segment_documents(docs, 2, 8))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    found = lambda: set(_hits(search.stored_search(index, asked)).get(2, []))
    index.delete(ids(*range(0, 60, 2), 5000))  # 5000 is in no segment
    odd = set(range(1, 60, 2))
    assert found() == odd
    stats = index.statistics().collect()
    assert sum(r["n_tombstones"] for r in stats) == 31 and all(r["live_docs"] == r["n_docs"] for r in stats)
    before, listed = index.listed().count(), {r["segment"] for r in index.listed().collect()}
    assert index.merge() and index.listed().count() == before - 4  # three become one in both shards
    merged = {r["segment"] for r in index.listed().collect()} - listed
    assert {r["doc_id"] % 2 for r in index.visible("documents").collect() if r["segment"] in merged} == {1}
    index.vacuum()
    again = docs.where("doc_id = 4").withColumn("shard", X.shard_of(F.col("doc_id"), 2)).withColumn("segment_no", F.lit(90))
    index.flush(again)
    assert found() == odd | {4}


def test_search_cluster(spark, cluster, tmp_path):
    """Events are invisible until their segment is full or committed, and can be deleted then."""
    docs, asked, book = cluster
    asked = asked.where("query_id = 2").withColumn("top_k", F.lit(100))
    all_ = SearchCluster(spark, f"file://{tmp_path}/cluster", book, 2, 1000)
    found = lambda: _hits(all_.search(asked)).get(2, [])
    all_.tombstone(docs.select("doc_id"))  # nothing is flushed yet, so nothing is deleted
    all_.ingest(docs.where("doc_id < 40"), 0)
    assert all_.live_segment_count() == 0
    all_.commit_all()
    assert all_.live_segment_count() == 2
    all_.ingest(docs.where("doc_id >= 40"), 1)
    all_.tombstone(docs.where("doc_id % 2 = 0").select("doc_id"))
    assert sorted(found()) == list(range(1, 40, 2))
    all_.commit_all()
    all_.commit_all()  # nothing more to close
    assert sorted(found()) == [d for d in range(60) if d % 2 or d >= 40]  # what was pending is not deleted
    assert all_.index.listed().count() == 4
    all_.indexer.seal()
    with pytest.raises(ValueError, match="sealed"):
        all_.ingest(docs.limit(1), 2)


def test_bad_events(spark, cluster):
    docs, _, _ = cluster
    good = docs.limit(3).withColumn("segment", F.lit(0))
    check_events(good)
    acl = good.withColumn("content_terms", F.array(F.lit("_acl_read:group_even")))
    check_events(acl, strict_acl=False)
    bad = [acl, good.union(good), good.withColumn("doc_id", F.lit(-1)), good.withColumn("doc_id", F.lit(None).cast("bigint")), good.withColumn("embedding", F.lit(None).cast("array<float>")), good.withColumn("content_terms", F.array(F.lit("")))]
    for rows in bad:
        with pytest.raises(ValueError):
            check_events(rows)


def test_query_validation():
    lexical.check_queries([["a"]], [1])
    for terms, k in ([[[]], [1]], [[[""]], [1]], [[["a"]], [0]]):
        with pytest.raises(ValueError):
            lexical.check_queries(terms, k)


def test_streaming_ingest(spark, tmp_path):
    indexer = StreamIndexer(spark, f"file://{tmp_path}/stream", 1, 3)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id bigint")
    indexer.accept(ids(1, 2), 0)
    status = lambda: tuple(indexer.status().select("accepted", "segments", "pending").first())
    assert status() == (2, 0, 2) and indexer.visible().count() == 0
    indexer.accept(ids(3, 4), 1)
    indexer.accept(ids(3, 4), 1)  # a batch that is run again changes nothing
    assert status() == (4, 1, 1)
    assert sorted(r["doc_id"] for r in indexer.visible().collect()) == [1, 2, 3]
    indexer.commit_all()
    assert sorted(r["doc_id"] for r in indexer.visible().collect()) == [1, 2, 3, 4] and status() == (4, 2, 0)
    indexer.accept(ids(3, 4), 1)  # again after the commit
    assert status() == (4, 2, 0)
    indexer.accept(ids(5, 6, 7, 8), 2)  # a new segment begins after the commit
    assert status() == (8, 3, 1) and {r["doc_id"]: r["segment_no"] for r in indexer.visible().collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 2, 7: 2}
    indexer.commit_all()
    assert status() == (8, 4, 0) and indexer.visible().count() == 8
    with pytest.raises(ValueError):
        indexer.accept(ids(-1), 3)
    with pytest.raises(ValueError):
        StreamIndexer(spark, "x", 1, 0)


def test_file_stream(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("doc_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    indexer = StreamIndexer(spark, f"file://{tmp_path}/out", 2, 8)
    indexer.run(stream, f"file://{tmp_path}/checkpoint")
    indexer.run(stream, f"file://{tmp_path}/checkpoint")  # nothing new
    assert sum(r["accepted"] for r in indexer.status().collect()) == 50
    indexer.commit_all()
    seqs = indexer.visible().groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] for r in seqs)


def test_a_streamed_table_whose_files_come_in_any_order(spark, sf_dir, tmp_path):
    """Ids lie across more files than an ordinary micro-batch takes, and the segments are those of the SQL."""
    con = duckdb.connect()
    (tmp_path / "documents.parquet").mkdir()
    for name in ("embeddings", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    con.execute(f"CREATE TABLE documents AS SELECT d.* REPLACE (doc_id + 200 * i AS doc_id) FROM read_parquet('{sf_dir}/documents.parquet') d, range(3) r(i) WHERE doc_id < 200")
    for i in range(6):
        con.execute(f"COPY (SELECT * FROM documents WHERE doc_id % 6 = {5 - i}) TO '{tmp_path}/documents.parquet/part-{i}.parquet'")
    want = con.execute("SELECT query_id, doc_id, score, rank FROM (" + ORACLE_SQL["stream_lifecycle"] + ")").fetchall()
    got = queries.stream_lifecycle(spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted((q, d, round(s, 6), r) for q, d, s, r in got) == sorted((q, d, round(s, 6), r) for q, d, s, r in want)


def _moves(df, what="Exchange hashpartitioning"):
    """How often a plan has a node."""
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_document_frequency_moves_no_postings(spark):
    """Terms are added up before they are shuffled; an id that is there twice counts once."""
    once = spark.createDataFrame([(0, d, ["a", "a", f"t{d % 3}"]) for d in range(9)], DOCS)
    twice = once.union(spark.createDataFrame([(0, 0, ["a", "b"]), (1, 0, ["a"])], DOCS))
    for docs in (once, twice):
        want = sorted(map(tuple, lexical.term_stats(lexical.term_frequency(docs)).collect()))
        assert sorted(map(tuple, lexical.document_frequency(docs).collect())) == want
    df = lexical.document_frequency(once)
    assert _moves(df) == 1 and "doc_id" not in df._jdf.queryExecution().optimizedPlan().toString().partition("LogicalRDD")[0]


def test_postings_move_once_and_are_sorted_once(spark):
    """In one segment, given by a literal, as in many; also where they are cut in blocks."""
    rows = [(s, d, ["x", "y", "x", f"t{d}"]) for s in range(3) for d in range(20)]
    for docs in (spark.createDataFrame(rows, DOCS).where("segment = 0").withColumn("segment", F.lit(0)), spark.createDataFrame(rows, DOCS)):
        posted = lexical.postings(docs)
        assert _moves(posted) == 1 and _moves(posted, "Sort [") == 1
        assert {r["term"]: (r["tf"], r["df"], r["doc_len"]) for r in posted.where("segment = 0 and doc_id = 7").collect()} == {"x": (2, 20, 4), "y": (1, 20, 4), "t7": (1, 1, 4)}
    cut = lexical.blocks(lexical.postings(docs), largest=20)
    assert _moves(cut) == 1 and _moves(cut, "Sort [") == 1


def test_counted_terms(spark):
    got = spark.createDataFrame([(["b", "a", None, "b"],), ([],), (None,)], "t array<string>").select(X.counted(F.col("t")).alias("n")).collect()
    assert [r["n"] and [tuple(x) for x in r["n"]] for r in got] == [[(None, 1), ("a", 1), ("b", 2)], None, None]


def test_tasks_stay_of_a_size(spark, monkeypatch):
    """Numbering gives no task more than some chunks of events; a shard is dealt to many."""
    monkeypatch.setattr(segments, "TASK_EVENTS", 64)
    monkeypatch.setattr(segments, "CHUNK_IDS", 32)
    rows = segments.assign(spark.range(4000).withColumnRenamed("id", "doc_id"), 1, 10)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 400
    assert tasks(spark, 10_000_000, 1000) == 10_000 and tasks(spark, 0) == spark.sparkContext.defaultParallelism
