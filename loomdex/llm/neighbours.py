"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Each vector is projected to M dimensions with independent standard normals. For two vectors at distance
d, the squared projected distance is d**2 times a chi-square variable of M degrees of freedom. So once
the nearest unread part of the projected space is farther than d_k * sqrt(q), with d_k the distance to
the k-th neighbour so far and q the CONFIDENCE quantile of that distribution, each nearer vector would
have been read with at least that chance, and the search stops.

The projected space is halved at medians into cells of at most about CELL vectors, which are the tasks.
Inside a cell a kd-tree goes on down to leaves, and the leaves are read in the order of their distance:
a query and a leaf meet as long as the test allows, and the true distances decide. A query starts in its
own cell and then visits every other cell that the test does not rule out.

Of equal vectors only the K of the least ids are indexed: no other can be among anyone's K nearest, as ties go to
the lesser id. The members of a group of more than K are answered from its K + 1 least ids. So a group of copies, however
large, is a few rows, and rows that equal one of them are found all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm.common import discard, materialize, small_side

K = 10
M = 8  # even
CONFIDENCE = 0.95
CELL = 16_384
LEAF = 256
QUERIES = 256  # that go through the leaves together
SEED = 11


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution of an even number m of degrees of freedom."""
    if m < 2 or m % 2:
        raise ValueError("the number of projections must be even")
    lo, hi = 0.0, 1000.0 + 10 * m
    for _ in range(200):
        x = (lo + hi) / 2
        term, total = 1.0, 0.0
        for j in range(m // 2):
            total += term
            term *= x / 2 / (j + 1)
        lo, hi = (x, hi) if 1 - math.exp(-x / 2) * total < p else (lo, x)
    return lo


def directions(dim: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(id, v) of the usable rows: an id, a vector without nulls or NaNs and of the commonest length (the
    greatest of several). Of rows that repeat an id the least vector is taken."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0").where(~bad)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def cells(projected: DataFrame, cell: int = CELL, m: int = M) -> DataFrame:
    """(id, p, cell) of projected(id, p), written. Each cell of more than `cell` vectors is cut at the
    median of its widest dimension, until none is left; medians are of all its vectors."""
    now = projected.select("id", "p", F.lit(1).cast("bigint").alias("cell"))
    written: list[DataFrame] = []
    while True:
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[(F.max(F.col("p")[j]) - F.min(F.col("p")[j])).alias(f"w{j}") for j in range(m)])
        big = sizes.where(F.col("n") > cell)
        widest = F.array_position(F.array(*[F.col(f"w{j}") for j in range(m)]), F.greatest(*[F.col(f"w{j}") for j in range(m)])) - 1
        big = materialize(big.where(F.greatest(*[F.col(f"w{j}") for j in range(m)]) > 0).select("cell", widest.cast("int").alias("dim")), "splits")
        if big.isEmpty():
            discard(big)
            return now
        x = F.element_at("p", F.col("dim") + 1)
        cuts = now.join(small_side(big), "cell").groupBy("cell", "dim").agg(F.percentile_approx(x, 0.5, 10_000).alias("cut"), F.min(x).alias("least"))
        # a median that equals the least value goes to the right with nothing on its left
        cuts = materialize(cuts.select("cell", "dim", "cut", (F.col("cut") == F.col("least")).alias("low")), "cuts")
        split = now.join(small_side(cuts), "cell", "left")
        right = F.when(F.col("low"), x > F.col("cut")).otherwise(x >= F.col("cut"))
        now = materialize(split.select("id", "p", F.when(F.col("dim").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + right.cast("bigint")).alias("cell")), "cells")
        discard(big, cuts, *written)
        written = [now]


class Tree:
    """Leaves of a kd-tree over projections, and the search through them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, p: np.ndarray, leaf: int = LEAF) -> None:
        todo, leaves = [np.arange(len(ids))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            dim = int(np.argmax(np.ptp(p[rows], axis=0)))
            rows = rows[np.argpartition(p[rows, dim], len(rows) // 2)]
            todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ids, self.v, self.p = ids[order], v[order], p[order]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.lo = np.minimum.reduceat(self.p, self.starts, axis=0) if leaves else p[:0]
        self.hi = np.maximum.reduceat(self.p, self.starts, axis=0) if leaves else p[:0]
        self.norm = (self.v**2).sum(1)

    def search(self, qid: np.ndarray, qv: np.ndarray, qp: np.ndarray, bound: np.ndarray, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of up to k neighbours of each query, nearest first and ties by id, -1
        where there are fewer; bound: squared distances beyond which none is wanted."""
        n = len(qid)
        ids, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
        if not n or not len(self.ids):
            return ids, dist
        gap = np.zeros((n, len(self.starts)))
        for j in range(qp.shape[1]):
            x = qp[:, j : j + 1]
            gap += np.maximum(np.maximum(self.lo[:, j] - x, x - self.hi[:, j]), 0) ** 2
        limit = bound.copy()
        q2 = (qv**2).sum(1)
        for leaf in np.argsort(gap.min(0), kind="stable"):
            live = np.flatnonzero(gap[:, leaf] <= quantile * limit)
            if not len(live):
                continue
            a, b = self.starts[leaf], self.ends[leaf]
            # distances by the products, rough to their rounding, tell which to compute by the differences
            rough = q2[live, None] + self.norm[None, a:b] - 2 * (qv[live] @ self.v[a:b].T)
            slack = 1e-9 * (q2[live] + self.norm[a:b].max())
            rough[self.ids[None, a:b] == qid[live, None]] = np.inf
            most = limit[live] + slack
            if b - a > k:
                most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
            row, col = np.nonzero((rough <= most[:, None]) & np.isfinite(rough))
            if not len(row):
                continue
            d = np.concatenate([((qv[live[row]] - self.v[a + col]) ** 2).sum(1), dist[live].reshape(-1)])
            i = np.concatenate([self.ids[a + col], ids[live].reshape(-1)])
            row = np.concatenate([row, np.repeat(np.arange(len(live)), k)])
            order = np.lexsort((i, d, row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < k
            dist[live[row[best]], place[best]], ids[live[row[best]], place[best]] = d[order][best], i[order][best]
            limit[live] = np.minimum(limit[live], dist[live, k - 1])
        return ids, dist


_FOUND = "id bigint, other bigint, d double"


def _search(tree: Tree, qid, qv, qp, bound, k: int, quantile: float) -> pa.Table:
    parts = []
    for s in range(0, max(len(qid), 1), QUERIES):
        e = s + QUERIES
        ids, dist = tree.search(qid[s:e], qv[s:e], qp[s:e], bound[s:e], k, quantile)
        who, where = np.nonzero(np.isfinite(dist))
        parts.append(pa.table({"id": qid[s:e][who], "other": ids[who, where], "d": dist[who, where]}))
    return pa.concat_tables(parts)


def _home(k: int, quantile: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, v, p = rows["id"].to_numpy(), _matrix(rows["v"]), _matrix(rows["p"])
        asks = np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False))
        asks = asks[np.lexsort(p[asks].T)]  # neighbouring queries read the same leaves
        return _search(Tree(ids, v, p), ids[asks], v[asks], p[asks], np.full(len(asks), np.inf), k, quantile)

    return run


def _away(k: int, quantile: float):
    def run(here: pa.Table, asking: pa.Table) -> pa.Table:
        if not here.num_rows or not asking.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        tree = Tree(here["id"].to_numpy(), _matrix(here["v"]), _matrix(here["p"]))
        qp, qv = _matrix(asking["q_p"]), _matrix(asking["q_v"])
        near = np.lexsort(qp.T)  # neighbouring queries read the same leaves
        qid, bound = asking["q_id"].to_numpy(), asking["q_bound"].to_numpy()
        return _search(tree, qid[near], qv[near], qp[near], bound[near], k, quantile)

    return run


def _gap(m: int) -> Column:
    """Squared distance of a query's projection to a cell's box."""
    out = F.lit(0.0)
    for j in range(m):
        out = out + F.pow(F.greatest(F.col("lo")[j] - F.col("p")[j], F.col("p")[j] - F.col("hi")[j], F.lit(0.0)), F.lit(2.0))
    return out


def _copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((id, v, asks) of the rows to index; (id, other, d) of those that ask and have k equals or more). Each task keeps k + 1
    rows of each vector before they move."""
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    least = materialize(rows.withColumn("place", place).where(F.col("place") <= k + 1), "least")
    full = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("least")).where(F.size("least") == k + 1)
    full = materialize(full.select(F.xxhash64("v").alias("h"), "v", "least"), "copies")
    asking = rows.where("asks").select("id", F.xxhash64("v").alias("h"), F.col("v").alias("own"))
    asking = asking.join(small_side(full, 100_000), "h").where(F.col("own") == F.col("v"))
    others = F.slice(F.filter("least", lambda x: x != F.col("id")), 1, k)
    answered = materialize(asking.select("id", F.explode(others).alias("other"), F.lit(0.0).alias("d")), "answered")
    index = least.where(F.col("place") <= k).join(small_side(full.select("h", F.col("v").alias("w")), 100_000), (F.xxhash64("v") == F.col("h")) & (F.col("v") == F.col("w")), "left")
    return index.select("id", "v", (F.col("asks") & F.col("w").isNull()).alias("asks")), answered


def nearest_neighbours(vectors: DataFrame, k: int = K, m: int = M, confidence: float = CONFIDENCE, cell: int = CELL, seed: int = SEED, asking: Column | None = None) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): for every vector that asks its k nearest others, rank 1 the nearest.

    asking: a condition on vec_id; if it is not given, every vector asks. All rows are searched. Each true neighbour is
    found with a chance of at least about `confidence`. Ties go to the lesser id, also at the k-th place;
    vectors with equal elements are each other's neighbours at distance 0. With fewer than k other
    vectors there are fewer rows. Rows without an id, and vectors that are null, empty, hold a null or
    NaN, or differ in length from the most, are left out; of rows that repeat an id one counts. Columns
    other than vec_id and embedding are not read. An empty table gives an empty one.
    """
    if k < 1:
        raise ValueError("k must be positive")
    quantile = chi_square_quantile(confidence, m)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v):
                continue
            p = v @ directions(v.shape[1], m, seed)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, m, dtype=np.int32)), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("asks"), flat], ["id", "v", "asks", "p"])

    rows = clean_vectors(vectors).withColumn("vec_id", F.col("id"))
    rows = rows.select("id", "v", (F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))).alias("asks"))
    index, answered = _copies(materialize(rows, "vectors"), k)
    projected = materialize(index.mapInArrow(project, "id bigint, v array<double>, asks boolean, p array<double>"), "projected")
    placed = materialize(projected.join(cells(projected, cell, m).select("id", "cell"), "id"), "placed")
    home = materialize(placed.groupBy("cell").applyInArrow(_home(k, quantile), _FOUND), "neighbours")
    # what the home cell gives bounds the search elsewhere; without k of them nothing is bounded
    bound = home.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("b"))
    boxes = placed.groupBy("cell").agg(F.array(*[F.min(F.col("p")[j]) for j in range(m)]).alias("lo"), F.array(*[F.max(F.col("p")[j]) for j in range(m)]).alias("hi"))
    boxes = materialize(boxes.withColumnRenamed("cell", "to"), "boxes")
    # first the boxes of about as many subtrees as each has cells, then those of their cells
    levels = (boxes.agg(F.max(F.length(F.bin("to")))).first()[0] or 1) // 2 + 1
    boxes = boxes.withColumn("subtree", F.expr(f"shiftright(to, greatest(length(bin(to)) - {levels}, 0))"))
    wide = boxes.groupBy("subtree").agg(F.array(*[F.min(F.col("lo")[j]) for j in range(m)]).alias("lo"), F.array(*[F.max(F.col("hi")[j]) for j in range(m)]).alias("hi"))
    near = _gap(m) <= F.lit(quantile) * F.col("bound")
    asked_for = placed.where("asks").drop("asks").join(bound, "id", "left").withColumn("bound", F.coalesce("b", F.lit(float("inf"))))
    asked_for = asked_for.crossJoin(small_side(materialize(wide, "subtrees"))).where(near).drop("lo", "hi")
    asked_for = asked_for.join(small_side(materialize(boxes, "cell-boxes")), "subtree").where((F.col("to") != F.col("cell")) & near)
    # a cell that many ask is searched by many tasks, each with about as many queries as a cell has vectors
    parts = asked_for.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    parts = small_side(materialize(parts, "parts"))
    queries = asked_for.join(parts, "to").select("to", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in ("id", "v", "p", "bound")])
    asked = placed.join(parts, F.col("cell") == F.col("to")).select("id", "v", "p", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    away = asked.groupBy("cell", "part").cogroup(queries.groupBy("to", "q_part")).applyInArrow(_away(k, quantile), _FOUND)
    best = F.row_number().over(W.partitionBy("id").orderBy("d", "other"))
    ranked = home.union(away).union(answered).withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbor_id"), "rank", F.sqrt("d").alias("distance"))
