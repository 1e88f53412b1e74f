"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm.common import HEAVY_ROWS, discard, materialize, with_aggregates


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges(a, b), bigint: label is the least node of its component.

    Loops, repeated edges and either direction are allowed; a node of loops only has no row. Each
    round is two minima of neighbours over ids, written to the shared folder; the rounds grow with the logarithm
    of the component's size, not with its diameter. A node may have any number of neighbours.
    """
    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(e)

    def least(rows: DataFrame) -> DataFrame:
        if 2 * before[0] <= HEAVY_ROWS:  # no node can be heavy
            return rows.withColumn("m", F.min("b").over(W.partitionBy("a")))
        return with_aggregates(rows, "a", ["a"], m=("min", "b"))

    while before[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = least(large)
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, materialize(small, "edges")
        discard(old)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
