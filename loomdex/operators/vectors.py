"""Product quantisation: codebook, codes, distance tables and exact top-k over the codes; and a
navigable graph over them for approximate search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators.lexical import most_wanted, top_k

M, K = 8, 16


def check_shape(dim: int, m: int, k: int) -> None:
    if m < 1 or dim % m or not 1 <= k <= 256:
        raise ValueError("the dimension must divide into m parts, and k lie between 1 and 256")


def codebook(vectors: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """(m, k, centroid): for part m, centroid k, the part of one training vector of vectors(vec_id, embedding): those of
    the k ids that come first in an order by a hash of the id and m, so that a codebook can be made again from the same
    table, whatever its ids. Rows without an id or a vector do not train; of rows that repeat an id one does."""
    rows = vectors.where("vec_id is not null and embedding is not null")
    n = rows.agg(F.count_distinct("vec_id").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("dim")).first()
    if n["n"] < k:
        raise ValueError("there are fewer training vectors than centroids")
    if n["least"] != n["dim"]:
        raise ValueError("training vectors differ in length")
    check_shape(n["dim"], m, k)
    part = n["dim"] // m
    ids = rows.select("vec_id").distinct().select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("m"))
    order = W.partitionBy("m").orderBy(X.fmix32(F.col("vec_id") * m + F.col("m")), "vec_id")
    pick = ids.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < k)
    book = rows.join(F.broadcast(pick), "vec_id").select("m", "k", F.slice("embedding", F.col("m") * part + 1, part).alias("centroid"))  # m * k rows
    return book.groupBy("m", "k").agg(F.min("centroid").alias("centroid"))


def collect_codebook(book: DataFrame) -> np.ndarray:
    """The (m, k, part) array of a codebook; its size does not depend on the data."""
    rows = book.orderBy("m", "k").collect()
    m, k = (max((r[c] for r in rows), default=-1) + 1 for c in ("m", "k"))
    if not rows or [(r["m"], r["k"]) for r in rows] != [(i, j) for i in range(m) for j in range(k)] or len({len(r["centroid"]) for r in rows}) != 1:
        raise ValueError("a codebook needs each centroid of each part once, all of one length")
    return np.array([r["centroid"] for r in rows], np.float32).reshape(m, k, -1)


def _distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, m, k) of vectors' parts to centroids: differences in single precision,
    squares added in double, in order."""
    m, k, part = book.shape
    x = v.astype(np.float32).reshape(len(v), m, 1, part)
    out = np.zeros((len(v), m, k))
    for j in range(part):
        d = (x[:, :, :, j] - book[None, :, :, j]).astype(np.float64)
        out += d * d
    return out


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != dim * len(column):
        raise ValueError(f"vectors must have {dim} elements")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def encode(embedding: Column, book: np.ndarray) -> Column:
    """The nearest centroid of each part (the lowest of equals), as array<smallint>."""
    m, k, part = book.shape

    def run(v: pa.Array) -> pa.Array:
        codes = _distances(_rows(v, m * part), book).argmin(2).astype(np.int16)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, m, dtype=np.int32)), pa.array(codes.reshape(-1)))

    return F.arrow_udf(run, "array<smallint>")(embedding)


def distance_table(vector: Column, book: np.ndarray) -> Column:
    """A query's distances to all centroids, as array<float> of m * k: part by part."""
    m, k, part = book.shape

    def run(v: pa.Array) -> pa.Array:
        lut = _distances(_rows(v, m * part), book).astype(np.float32).reshape(len(v), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, lut.size + 1, m * k, dtype=np.int32)), pa.array(lut.reshape(-1)))

    return F.arrow_udf(run, "array<float>")(vector)


def adc(lut: Column, code: Column, m: int = M, k: int = K) -> Column:
    """The asymmetric distance of a code: m table cells added in single precision, in order."""
    out = lut[code[0].cast("int")]
    for j in range(1, m):
        out = (out + lut[F.lit(j * k) + code[j]]).cast("float")
    return out


def search(codes: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("query_id",), k: int | None = None, m: int = M, n_centroids: int = K) -> DataFrame:
    """(*by, doc_id, score, rank): the nearest of codes(segment, doc_id, code) to each of queries(query_id,
    lut, top_k), by exact scan; the score is the negated distance.

    If queries has tokens, each reads only the codes of which acl_tokens, an array beside the code, has one of them:
    that is settled where the code lies, and nothing is shuffled but the best of each task."""
    batch = F.broadcast(queries.select("query_id", "lut", "top_k", *(["tokens"] if "tokens" in queries.columns else [])))  # a batch of queries
    if "tokens" in queries.columns:
        pairs = codes.join(batch, F.arrays_overlap("acl_tokens", "tokens"))
    else:
        pairs = codes.crossJoin(batch)
    scored = pairs.select("query_id", "segment", "doc_id", "top_k", (-adc(F.col("lut"), F.col("code"), m, n_centroids)).cast("double").alias("score"))
    best = top_k(scored, list(by), F.col("top_k"), most_wanted(queries)) if k is None else top_k(scored, list(by), k)
    return best.select(*by, "doc_id", "score", "rank")


# --- graph mode


class Graph:
    """A single-layer proximity graph over codes, built in the order of the ids."""

    def __init__(self, book: np.ndarray, most: int = 16) -> None:
        if most < 2:
            raise ValueError("a node needs room for two neighbours")
        self.book, self.most = book, most
        self.codes: dict[int, np.ndarray] = {}
        self.links: dict[int, list[int]] = {}

    def _near(self, table: np.ndarray, ids: list[int]) -> np.ndarray:
        codes = np.stack([self.codes[i] for i in ids])
        out = np.zeros(len(ids), np.float32)
        for j in range(codes.shape[1]):
            out += table[j, codes[:, j]]
        return out

    def beam(self, vector: np.ndarray, width: int, allowed: set[int] | None = None) -> list[tuple[float, int]]:
        """Up to `width` (distance, id) reached best first from the first node; nodes that are not allowed
        are walked through but not returned."""
        if not self.codes:
            return []
        table = _distances(vector[None], self.book)[0].astype(np.float32)
        start = next(iter(self.codes))
        seen = {start}
        frontier = [(float(self._near(table, [start])[0]), start)]
        best: list[tuple[float, int]] = [(-frontier[0][0], -start)] if allowed is None or start in allowed else []
        while frontier:
            d, node = heapq.heappop(frontier)
            if len(best) == width and d > -best[0][0]:
                break
            fresh = [x for x in self.links[node] if x not in seen]
            seen.update(fresh)
            for x, dist in zip(fresh, self._near(table, fresh).tolist() if fresh else []):
                if len(best) < width or dist < -best[0][0]:
                    heapq.heappush(frontier, (dist, x))
                    if allowed is None or x in allowed:
                        heapq.heappush(best, (-dist, -x))
                        if len(best) > width:
                            heapq.heappop(best)
        return sorted((-d, -x) for d, x in best)

    def insert(self, node: int, vector: np.ndarray) -> None:
        """Link a node to its nearest; a full neighbour gives up its link that is farthest from the newcomer."""
        near = [x for _, x in self.beam(vector, self.most)]
        table = _distances(vector[None], self.book)[0]
        self.codes[node] = table.argmin(1)
        self.links[node] = near
        for x in near:
            if len(self.links[x]) < self.most:
                self.links[x].append(node)
            else:
                self.links[x][int(np.argmax(self._near(table.astype(np.float32), self.links[x])))] = node


def graph_search(vectors: DataFrame, queries: pd.DataFrame, book: np.ndarray, most: int = 16, k: int = 10) -> DataFrame:
    """(segment, query_id, doc_id, score): each segment's graph is built and searched in one task.
    vectors(segment, doc_id, embedding, acl_tokens); queries: query_id, vector, tokens (None sees all).
    Segments are of bounded size, by the indexer."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        graph = Graph(book, most)
        for node, v in zip(rows["doc_id"], rows["embedding"]):
            graph.insert(int(node), np.asarray(v, np.float32))
        out = []
        for q in queries.itertuples():
            seen = None if q.tokens is None else {int(i) for i, t in zip(rows["doc_id"], rows["acl_tokens"]) if set(t) & set(q.tokens)}
            out += [(int(rows["segment"].iloc[0]), int(q.query_id), x, -d) for d, x in graph.beam(np.asarray(q.vector, np.float32), k, seen)]
        return pd.DataFrame(out, columns=["segment", "query_id", "doc_id", "score"])

    return vectors.groupBy("segment").applyInPandas(run, "segment int, query_id int, doc_id bigint, score double")
