"""Sets of document ids: access filters, tombstones, set algebra and bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import expressions as X

CHUNK_BITS = 16


def readable(docs: DataFrame, principals: DataFrame) -> DataFrame:
    """(query_id, doc_id): what each of principals(query_id, user_id, acl_tokens) may read of
    docs(doc_id, terms): documents with an access term for one of its tokens. No token, no document."""
    asked = principals.select("query_id", F.explode(X.acl_terms(X.principal_tokens(F.col("user_id"), F.col("acl_tokens")))).alias("term"))
    grants = docs.select("doc_id", F.explode("terms").alias("term")).where(X.is_acl_term(F.col("term")))
    return grants.join(F.broadcast(asked), "term").select("query_id", "doc_id").distinct()  # a batch of principals


def readable_postings(posted: DataFrame, principals: DataFrame) -> DataFrame:
    """readable() from postings(term, doc_id): the union of the lists of each principal's access terms."""
    asked = principals.select("query_id", F.explode(X.acl_terms(X.principal_tokens(F.col("user_id"), F.col("acl_tokens")))).alias("term"))
    wanted = [r["term"] for r in asked.select("term").distinct().collect()]  # a batch of principals
    return posted.where(F.col("term").isin(wanted)).join(F.broadcast(asked), "term").select("query_id", "doc_id").distinct()


def add_ids(ids: DataFrame, new: DataFrame) -> DataFrame:
    """The set with new ids; an id that it has changes nothing, a null or negative one fails the query."""
    checked = F.when(F.coalesce(F.col("doc_id") >= 0, F.lit(False)), F.col("doc_id")).otherwise(F.raise_error(F.lit("an id must be 0 or more")).cast("bigint"))
    return union_ids(ids, new.select(checked.alias("doc_id")))


def ascending(ids: DataFrame) -> DataFrame:
    """(doc_id, chunk_key, offset): the distinct ids in order, with their high and low bits."""
    distinct = ids.select("doc_id").distinct()
    return distinct.select("doc_id", F.shiftright("doc_id", CHUNK_BITS).alias("chunk_key"), F.col("doc_id").bitwiseAND((1 << CHUNK_BITS) - 1).alias("offset")).orderBy("doc_id")


def union_ids(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("doc_id")
    for s in sets[1:]:
        out = out.union(s.select("doc_id"))
    return out.distinct()


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def subtract_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").subtract(b.select("doc_id"))


def contains(ids: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, present) for each of probes(doc_id); a negative id is never present."""
    marked = ids.select("doc_id").distinct().withColumn("hit", F.lit(True))
    return probes.select("doc_id").join(marked, "doc_id", "left").select("doc_id", (F.coalesce("hit", F.lit(False)) & (F.col("doc_id") >= 0)).alias("present"))


def chunks(ids: DataFrame) -> DataFrame:
    """(chunk_key, cardinality): how many distinct ids share their high bits."""
    return ids.groupBy(F.shiftright("doc_id", CHUNK_BITS).alias("chunk_key")).agg(F.countDistinct("doc_id").alias("cardinality"))


def cardinality(ids: DataFrame) -> DataFrame:
    """(cardinality): the number of distinct ids, by bitmaps of fixed size that merge in any order."""
    maps = ids.groupBy(F.expr("bitmap_bucket_number(doc_id + 1)").alias("bucket")).agg(F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(doc_id + 1)))").alias("n"))
    return maps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cardinality"))


def live(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows of docs that are not deleted."""
    return docs.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
