"""The corpus operators as queries over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import mixing, neardup, neighbours, packing, pii, ranking, repetition, sharding, tokens
from loomdex.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


ARRIVALS = 8  # batches that the documents arrive in, by ranges of their ids


def op1_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read from a store that they arrived in batch by batch, with a digest of each text; whether the store
    has fewer shards than were appended, and how many of its tiers still wait to be merged."""
    docs = table(spark, sf_dir, "documents")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [(least or 0) + ((most or 0) - (least or 0)) * k // ARRIVALS for k in range(1, ARRIVALS)]
    arrivals = [docs.where(f"doc_id is null or doc_id < {cuts[0]}"), *[docs.where(f"doc_id >= {a} and doc_id < {b}") for a, b in zip(cuts, cuts[1:])], docs.where(f"doc_id >= {cuts[-1]}")]
    store, appended = sharding.sharded(arrivals, fresh_path(spark, "store"))
    shards = store.manifest()[1]
    due = sum(len(t) >= store.fan_in for t in store.tiers(shards).values())
    text = F.md5(F.encode("text", "UTF-8")).alias("text_md5")
    return store.read().select("doc_id", "lang", "source", "n_chars", text, F.lit(len(shards) < appended).alias("merged"), F.lit(due).alias("tiers_due"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay within the repetition limits, with what was measured."""
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources mixed to smoothed weights, a row for each drawn block of token ids."""
    return mixing.mixed_blocks(table(spark, sf_dir, "documents"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near-duplicate, with its group."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, packed to the vocabulary's width."""
    return tokens.packed_tokens(table(spark, sf_dir, "documents"))


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents above the quality threshold, with their scores."""
    return ranking.keep_best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the documents' tokens are packed into, with what lies where."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every one whose id is divisible by 100."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), asking=F.col("vec_id") % 100 == 0)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed spans of personal data in the documents."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_tiered_sharding, op2_suffix_repetition, op3_source_mixing, op4_minhash_neardup, op5_packed_token_ids,
        op6_pairwise_quality, op7_hierarchical_packing, op8_projected_neighbours, op9_pii_spans, op10_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_tiered_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, true AS merged, 0 AS tiers_due FROM documents",
}
