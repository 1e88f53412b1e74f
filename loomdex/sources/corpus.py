"""The retrieval corpus and the batch of queries over it, read from a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import expressions as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, doc_id, terms) of all documents as one segment, without access terms."""
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("segment"), "doc_id", X.terms(F.col("text")).alias("terms"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document events: every document that has an embedding, with its access tokens, its vector and the
    four parts of it that late interaction compares."""
    return events_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


def events_of(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """events() of documents, a stream of them too."""
    rows = docs.join(vectors, docs["doc_id"] == vectors["vec_id"])
    acl = F.array(F.concat(F.lit("group_"), "source"), F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("user_"), (F.col("doc_id") % 7).cast("string")))
    return rows.select("doc_id", X.terms(F.col("text")).alias("content_terms"), acl.alias("acl_tokens"), F.col("text").alias("payload"), "embedding", _parts(F.col("embedding")).alias("colbert_tokens"))


def _parts(embedding):
    return F.array(*[F.slice(embedding, 1 + 16 * i, 16) for i in range(4)])


def indexed(docs: DataFrame, segment) -> DataFrame:
    """(segment, doc_id, terms) of events: content terms and access terms together."""
    return docs.select(segment.alias("segment"), "doc_id", F.concat("content_terms", X.acl_terms(F.col("acl_tokens"))).alias("terms"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the deleted documents: those labelled toxic."""
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")


#: query_id, terms, user, tokens, top_k; the query's vectors are those of the document of its number
QUERIES = [
    (1, ["the", "and"], "3", ["group_src1"], 20),
    (2, ["the", "of", "in"], "1", ["lang_en"], 10),
    (3, ["de", "la"], "2", ["lang_fr", "lang_es"], 15),
    (4, ["und"], "5", ["group_src0", "lang_de"], 10),
    (5, ["the", "and", "the"], "0", [], 10),
    (6, ["the", "no-such-term"], "3", ["lang_en"], 10),
]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of queries: query_id, lexical_terms, user_id, acl_tokens, top_k, dense_vector, colbert_tokens."""
    asked = spark.createDataFrame(QUERIES, "query_id int, lexical_terms array<string>, user_id string, acl_tokens array<string>, top_k int")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.join(F.broadcast(asked), F.col("vec_id") == F.col("query_id")).select("query_id", "lexical_terms", "user_id", "acl_tokens", "top_k", F.col("embedding").alias("dense_vector"), _parts(F.col("embedding")).alias("colbert_tokens"))


def readers(asked: DataFrame) -> DataFrame:
    """queries() with `tokens`, those of which a document must grant one to be read; with it searches filter by access."""
    return asked.withColumn("tokens", X.principal_tokens(F.col("user_id"), F.col("acl_tokens")))


def wanted(asked: list[tuple] = QUERIES) -> list[str]:
    """The terms that a batch of queries reads: its own, and the access terms of its readers."""
    terms = {t for _, terms, _, _, _ in asked for t in terms}
    return sorted(terms | {X.ACL_PREFIX + t for _, _, user, tokens, _ in asked for t in [f"user_{user}", *tokens]})
