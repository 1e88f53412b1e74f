"""Reciprocal rank fusion of ranked channels, and late-interaction reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators.lexical import top_k


def fuse(channels: list[DataFrame], by: list[str], limit: int | None = None, k: int = X.RRF_K) -> DataFrame:
    """(*by, doc_id, score, rank): ranked lists (*by, doc_id, rank) fused; a list that lacks a document adds
    nothing. Scores are added in the order of the channels."""
    parts = [c.select(*by, "doc_id", F.lit(i).alias("channel"), "rank") for i, c in enumerate(channels)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ranks = F.array_sort(F.collect_list(F.struct("channel", "rank")))["rank"]
    return top_k(both.groupBy(*by, "doc_id").agg(X.rrf(ranks, k).alias("score")), by, limit)


def rerank(candidates: DataFrame, queries: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """(*by, doc_id, score, rank): candidates(*by, doc_id), query_id among by, ordered by MaxSim between the
    vectors of queries(query_id, colbert_tokens, top_k) and of tokens(doc_id, colbert_tokens), cut at top_k.
    A candidate without vectors scores 0."""
    asked = F.broadcast(queries.select("query_id", F.col("colbert_tokens").alias("asked"), "top_k"))  # a batch of queries
    key = ["segment", "doc_id"] if "segment" in by and "segment" in tokens.columns else ["doc_id"]
    rows = candidates.select(*by, "doc_id").join(asked, "query_id").join(tokens.select(*key, "colbert_tokens"), key, "left")
    scored = rows.select(*by, "doc_id", "top_k", X.max_sim(F.col("asked"), F.col("colbert_tokens")).alias("score"))
    return top_k(scored, by, F.col("top_k")).select(*by, "doc_id", "score", "rank")
