"""Nearest neighbours against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from loomdex.llm.neighbours import Tree, chi_square_quantile, nearest_neighbours
from loomdex.llm.queries import op8_projected_neighbours


def brute(ids, v, k):
    out = {}
    for i, x in zip(ids, v):
        d = np.sqrt(((v - x) ** 2).sum(1))
        out[i] = sorted((round(float(a), 6), j) for a, j in zip(d, ids) if j != i)[:k]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append((round(r["distance"], 6), r["neighbor_id"]))
        assert r["rank"] == len(out[r["vec_id"]])
    return out


@pytest.mark.parametrize("cell", [16_384, 100])
def test_recall(spark, sf_dir, cell):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.collect()
    want = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 10)
    got = _got(nearest_neighbours(vectors, cell=cell))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)
    for i, found in got.items():
        assert found == sorted(found)


def test_full_confidence_is_exact(spark):
    v = np.random.default_rng(2).normal(size=(300, 12))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    assert _got(nearest_neighbours(vectors, k=5, confidence=1 - 1e-12, cell=64)) == brute(range(300), v, 5)


def test_table_cases(spark):
    rows = [(1, [0.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, [3.0, 4.0], "x"), (4, None, "x"), (5, [], "x"), (6, [1.0, None], "x"), (7, [1.0, float("nan")], "x"), (8, [1.0], "x"), (None, [0.0, 0.0], "x"), (1, [0.0, 0.0], "x")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, `rank` string").selectExpr("*", "'clash' as cell", "1 as id", "2 as v")
    assert _got(nearest_neighbours(vectors)) == {1: [(0.0, 2), (5.0, 3)], 2: [(0.0, 1), (5.0, 3)], 3: [(5.0, 1), (5.0, 2)]}
    assert _got(nearest_neighbours(vectors, k=1)) == {1: [(0.0, 2)], 2: [(0.0, 1)], 3: [(5.0, 1)]}  # the tie goes to the lesser id
    assert nearest_neighbours(vectors.limit(0)).count() == 0
    assert nearest_neighbours(vectors.where("vec_id = 3")).count() == 0


def _table(spark, vectors):
    return spark.createDataFrame(list(vectors), "vec_id bigint, embedding array<double>")


def test_many_equal_vectors(spark):
    """A group of copies larger than a cell is a few rows of the index; neighbours and ties are those of brute force."""
    rows = [(i, [1.0, 2.0]) for i in range(150)] + [(1000 + i, [float(i), 0.0]) for i in range(150)] + [(2000 + i, [0.5, 7.0]) for i in range(3)]
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 3)
    assert _got(nearest_neighbours(_table(spark, rows), k=3, cell=32, confidence=1 - 1e-12)) == want


def test_ties_go_to_the_lesser_id(spark):
    """Few and many equal vectors, and others at equal distances, at the k-th place too."""
    for n in (3, 4, 15, 40):
        rows = [(i, [0.3, 0.1, 0.7]) for i in range(n)] + [(5000 + i, [float(i), 1.0, -1.0]) for i in range(300)]
        rows += [(7000 + i, [0.3 + s, 0.1, 0.7]) for i, s in enumerate([0.5, -0.5, 0.5, -0.5, 0.5])]
        want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 3)
        assert _got(nearest_neighbours(_table(spark, rows), k=3, confidence=1 - 1e-12)) == want
        if n == 15:
            assert [j for _, j in want[0]] == [1, 2, 3] and [j for _, j in want[7]] == [0, 1, 2]


def test_the_tree_keeps_ties_across_leaves():
    rng = np.random.default_rng(4)
    v = np.concatenate([np.tile(rng.normal(size=6), (40, 1)), rng.normal(size=(3000, 6))])
    ids = rng.permutation(len(v)).astype(np.int64)
    p = v @ rng.standard_normal((6, 8))
    got, dist = Tree(ids, v, p, leaf=16).search(ids[:200], v[:200], p[:200], np.full(200, np.inf), 5, 1e9)
    for q in range(200):
        d = ((v - v[q]) ** 2).sum(1)
        want = sorted((x, j) for x, j in zip(d.tolist(), ids.tolist()) if j != ids[q])[:5]
        assert list(zip(dist[q].tolist(), got[q].tolist())) == want


def test_the_query_asks_for_every_hundredth(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 10)
    got = _got(op8_projected_neighbours(spark, sf_dir))
    assert set(got) == {i for i in want if i % 100 == 0} and all(len(x) == 10 for x in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in got) >= 0.9 * 10 * len(got)


def test_quantile():
    # of two degrees of freedom the distribution is exponential
    assert chi_square_quantile(0.95, 2) == pytest.approx(-2 * np.log(0.05))
    sample = (np.random.default_rng(0).normal(size=(200_000, 8)) ** 2).sum(1)
    assert (sample <= chi_square_quantile(0.95, 8)).mean() == pytest.approx(0.95, abs=0.003)
    for bad in (0, 3):
        with pytest.raises(ValueError):
            chi_square_quantile(0.5, bad)
