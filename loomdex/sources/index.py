"""The index as stored tables: what a flush writes, and what a search reads.

A flush is a folder in each of the tables documents, postings, blocks, codes and segment_stats. The events are
written first, to documents; the rest is made from there. Postings are sorted by term within their files, so that
the terms of a query prune row groups; the tokens that grant reading lie beside the codes.
A flush lists its segments in the table segments last: a segment that is not listed there is not read, so a flush that
was lost half-way shows nothing of itself. A merge is a flush whose segments replace others.

A delete is a row of the table deletes, with the last segment that its shard had then: it hides the document in that
segment and in those before, not in one that is flushed later. One process writes at a time.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators import lexical, segments, vectors
from loomdex.sources.storage import delete, exists, names, tasks

SEGMENTS_A_SHARD = 1_000_000
MERGED = 500_000  # segment numbers of a shard from which merges are numbered
TABLES = ("documents", "postings", "blocks", "codes", "segment_stats")
LISTED = "segment bigint, order_no bigint, n_docs bigint, replaces array<bigint>, flush string"
DELETES = "doc_id bigint, order_no bigint, segment bigint"


def segment_id(shard: Column, segment_no: Column) -> Column:
    """One number for a shard's segment."""
    return (shard.cast("bigint") * SEGMENTS_A_SHARD + segment_no).alias("segment")


def shard_of_segment(segment: Column) -> Column:
    return F.floor(segment / SEGMENTS_A_SHARD).cast("int")


def check_events(events: DataFrame, strict_acl: bool = True) -> None:
    """Raise ValueError for events(segment, doc_id, content_terms, embedding) that cannot be indexed: no id or
    a negative one, an empty or missing vector, an empty term, an id twice in a segment, and, if
    strict_acl, a content term that would grant reading."""
    terms = F.coalesce("content_terms", F.array().cast("array<string>"))
    bad = F.coalesce(F.col("doc_id") < 0, F.lit(True)) | F.coalesce(F.size("embedding") < 1, F.lit(True)) | F.exists(terms, lambda t: F.coalesce(t == "", F.lit(True)))
    if strict_acl:
        bad = bad | F.exists(terms, X.is_acl_term)
    twice = events.groupBy("segment", "doc_id").count().where("count > 1")
    if not events.where(bad).isEmpty() or not twice.isEmpty():
        raise ValueError("an event needs an id of 0 or more that is not in its segment yet, a vector, and terms that are neither empty nor grants")


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str, book: np.ndarray, shards: int) -> None:
        self.spark, self.path, self.book, self.shards = spark, path.rstrip("/"), book, shards

    # --- writing

    def flush(self, events: DataFrame, strict_acl: bool = True) -> None:
        """Write events(shard, segment_no, doc_id, content_terms, acl_tokens, payload, embedding, colbert_tokens) as
        the segments they are numbered for."""
        rows = events.select(segment_id(F.col("shard"), F.col("segment_no")), "doc_id", "content_terms", F.coalesce("acl_tokens", F.array().cast("array<string>")).alias("acl_tokens"), "payload", "embedding", "colbert_tokens")
        self._write(rows, strict_acl)

    def _write(self, rows: DataFrame, strict_acl: bool = True, merges: DataFrame | None = None) -> None:
        """Write documents' rows as a flush. merges(segment, order_no, replaces): what its segments stand for, if they
        are merged ones."""
        flush = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/documents/{flush}")  # the events are evaluated here and never again
        kept = self._read("documents", [flush])
        try:
            check_events(kept, strict_acl)
        except ValueError:
            delete(self.spark, f"{self.path}/documents/{flush}")
            raise
        docs = kept.select("segment", "doc_id", F.concat(F.coalesce("content_terms", F.array().cast("array<string>")), X.acl_terms(F.col("acl_tokens"))).alias("terms"))
        lexical.postings(docs).sortWithinPartitions("term", "segment", "doc_id").write.parquet(f"{self.path}/postings/{flush}")
        largest = docs.groupBy("segment").count().agg(F.max("count")).first()[0]
        posted = self._read("postings", [flush])
        posted = posted.repartition(tasks(self.spark, posted.count()), "term", "segment")
        blocks = lexical.blocks(posted, largest=largest or 0)
        blocks.sortWithinPartitions("term", "segment", "block_no").write.parquet(f"{self.path}/blocks/{flush}")
        kept.select("segment", "doc_id", vectors.encode(F.col("embedding"), self.book).alias("code"), "acl_tokens").write.parquet(f"{self.path}/codes/{flush}")
        lexical.segment_stats(docs).coalesce(1).write.parquet(f"{self.path}/segment_stats/{flush}")
        listed = self._read("segment_stats", [flush]).select("segment", "n_docs")
        if merges is None:
            listed = listed.withColumn("order_no", F.col("segment") % SEGMENTS_A_SHARD).withColumn("replaces", F.array().cast("array<bigint>"))
        else:  # a merge that leaves nothing of its segments still replaces them
            listed = merges.join(listed, "segment", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        listed.select("segment", F.col("order_no").cast("bigint"), F.col("n_docs").cast("bigint"), "replaces", F.lit(flush).alias("flush")).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def delete(self, ids: DataFrame) -> None:
        """Mark ids(doc_id) as deleted in the shards they belong to, up to the last segment of each; a shard that has no
        segment yet knows nothing of them. A mark counts in each segment that holds the id, or in the shard's last one."""
        listed = self.listed().select("segment", "order_no")
        if listed.isEmpty():
            return
        last = listed.groupBy(shard_of_segment(F.col("segment")).alias("shard")).agg(F.max_by("segment", "order_no").alias("last"), F.max("order_no").alias("order_no"))  # a row a shard
        marks = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("shard", X.shard_of(F.col("doc_id"), self.shards))
        held = self.visible("documents").select("segment", "doc_id")
        placed = marks.join(F.broadcast(last), "shard").join(held, "doc_id", "left")
        placed.select("doc_id", "order_no", F.coalesce("segment", "last").alias("segment")).write.mode("append").parquet(f"{self.path}/deletes")

    def _marks(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/deletes"):
            return self.spark.createDataFrame([], DELETES)
        return self.spark.read.schema(DELETES).parquet(f"{self.path}/deletes")

    def deletes(self) -> DataFrame:
        """(doc_id, order_no): each deleted id with the last segment that it is deleted in."""
        return self._marks().groupBy("doc_id").agg(F.max("order_no").alias("order_no"))

    def statistics(self) -> DataFrame:
        """(shard, segment, position, n_docs, n_tombstones, tombstone_ratio, live_docs) of each segment. What a segment held
        when it was built stays its live count; marks go with the segments that a merge replaces."""
        listed = self.listed().select("segment", "order_no", "n_docs")
        tombs = self._marks().groupBy("segment").agg(F.count_distinct("doc_id").alias("n_tombstones"))
        out = listed.join(tombs, "segment", "left").withColumn("n_tombstones", F.coalesce("n_tombstones", F.lit(0).cast("bigint")))
        ratio = F.when(F.col("n_docs") > 0, F.col("n_tombstones") / F.col("n_docs")).otherwise(F.lit(0.0))
        return out.select(shard_of_segment(F.col("segment")).alias("shard"), "segment", F.col("order_no").alias("position"), "n_docs", "n_tombstones", ratio.alias("tombstone_ratio"), F.col("n_docs").alias("live_docs"))

    def merge(self, ratio: float = segments.TOMBSTONE_RATIO, factor: int = segments.MERGE_FACTOR) -> bool:
        """Merge the segments that pick_merge names in each shard into one, without the documents deleted in them; of
        a document that several hold the latest stays. Whether there was anything to merge."""
        picked = segments.pick_merge(self.statistics(), ["shard"], ratio, factor).select("shard", "segment", F.col("position").alias("order_no"))
        rows = picked.groupBy("shard").agg(F.sort_array(F.collect_list("segment")).alias("replaces"), F.max("order_no").alias("order_no")).collect()  # a row a shard
        if not rows:
            return False
        before = {r["shard"]: r["n"] for r in self._listing().where(F.size("replaces") > 0).groupBy(shard_of_segment(F.col("segment")).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
        merges = self.spark.createDataFrame([(r["shard"] * SEGMENTS_A_SHARD + MERGED + before.get(r["shard"], 0), r["order_no"], r["replaces"]) for r in rows], "segment bigint, order_no bigint, replaces array<bigint>")
        into = F.broadcast(merges.select(F.col("segment").alias("into"), F.explode("replaces").alias("segment")))
        orders = F.broadcast(self.listed().select("segment", F.col("order_no").alias("at")))
        live = self.visible("documents").join(into, "segment").join(orders, "segment")
        dead = self.deletes().select("doc_id", F.col("order_no").alias("until"))
        live = live.join(dead, "doc_id", "left").where(F.col("until").isNull() | (F.col("at") > F.col("until")))
        live = live.withColumn("newest", F.row_number().over(W.partitionBy("into", "doc_id").orderBy(F.desc("at"), F.desc("segment")))).where("newest = 1")
        self._write(live.select(F.col("into").alias("segment"), "doc_id", "content_terms", "acl_tokens", "payload", "embedding", "colbert_tokens"), False, merges)
        return True

    def vacuum(self) -> None:
        """Delete the flushes of which no segment is visible any more, or was ever listed. Nothing else may write."""
        used = set(self._flushes(self.listed()))
        for name in TABLES:
            for flush in names(self.spark, f"{self.path}/{name}"):
                if flush not in used:
                    delete(self.spark, f"{self.path}/{name}/{flush}")

    # --- reading

    def _read(self, name: str, flushes: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{f}" for f in flushes])

    def _listing(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/segments"):
            return self.spark.createDataFrame([], LISTED)
        return self.spark.read.schema(LISTED).parquet(f"{self.path}/segments").dropDuplicates(["segment"])

    def listed(self, visibility: str = "all") -> DataFrame:
        """(segment, order_no, n_docs, flush) of the visible segments: all that were not replaced by a merge, or the latest
        of each shard, which replaces those before."""
        rows = self._listing()
        rows = rows.join(F.broadcast(rows.select(F.explode("replaces").alias("segment"))), "segment", "left_anti").drop("replaces")  # a row a segment
        if visibility == "latest":
            return rows.withColumn("newest", F.row_number().over(W.partitionBy(shard_of_segment(F.col("segment"))).orderBy(F.desc("order_no"), F.desc("segment")))).where("newest = 1").drop("newest")
        if visibility != "all":
            raise ValueError("visibility is all or latest")
        return rows

    def _flushes(self, listed: DataFrame) -> list[str]:
        return [r["flush"] for r in listed.select("flush").distinct().collect()]  # a row a flush

    def visible(self, name: str, visibility: str = "all") -> DataFrame:
        """The rows of a table that belong to visible segments. Flushes that have none are not read."""
        listed = self.listed(visibility)
        flushes = self._flushes(listed)
        if not flushes:
            raise ValueError("nothing was flushed yet")
        return self._read(name, flushes).join(F.broadcast(listed.select("segment")), "segment", "left_semi")  # a row a segment

    def without_deleted(self, hits: DataFrame, visibility: str = "all") -> DataFrame:
        """The rows of hits(segment, doc_id, ...) whose document is not deleted in its segment."""
        if not exists(self.spark, f"{self.path}/deletes"):
            return hits
        orders = self.listed(visibility).select("segment", F.col("order_no").alias("at"))
        placed = hits.join(F.broadcast(orders), "segment")  # a row a segment
        dead = self.deletes().select(F.col("doc_id").alias("dead"), F.col("order_no").alias("until"))
        return placed.join(dead, (F.col("doc_id") == F.col("dead")) & (F.col("at") <= F.col("until")), "left_anti").drop("at")

    def fetch(self, hits: DataFrame, visibility: str = "all") -> DataFrame:
        """hits(doc_id, ...) with the payload of each."""
        return hits.join(self.visible("documents", visibility).select("doc_id", "payload"), "doc_id", "left")
