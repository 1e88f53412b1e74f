"""Segments over their life: flush numbering, statistics, deletes, merge selection and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.sources.storage import BROADCAST_ROWS, tasks

TOMBSTONE_RATIO, MERGE_FACTOR = 0.20, 3


CHUNK_IDS = 1 << 12  # ids that are numbered together
TASK_EVENTS = 1 << 12  # events, which may be wide, that one task sorts, about


def assign(events: DataFrame, shards: int, flush_at: int, base: DataFrame | None = None) -> DataFrame:
    """events with shard, seq (from 1 within the shard, by doc_id) and segment_no: every flush_at events of a shard
    make a segment, whatever batches they came in. Ids are numbered by chunks of them, and the counts of the
    chunks are added up, so that no task has a whole shard, or more than a few chunks of it.

    base(shard, n, cut, segments): events taken before, how many of them when segments were last closed by hand, and
    how many segments there were then."""
    if flush_at < 1:
        raise ValueError("flush_at must be positive")
    chunk = F.floor(F.col("doc_id") / CHUNK_IDS)
    routed = events.withColumn("shard", X.shard_of(F.col("doc_id"), shards))
    counts = routed.groupBy("shard", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("own"))
    before = counts.select("shard", "chunk", (F.sum("own").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("own")).alias("before"))
    n = counts.agg(F.count(F.lit(1)).alias("chunks"), F.sum("own").alias("events")).first()
    numbered = routed.withColumn("chunk", chunk).repartition(tasks(events.sparkSession, n["events"] or 0, TASK_EVENTS), "shard", "chunk")
    numbered = numbered.withColumn("seq", F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id")))
    numbered = numbered.join(F.broadcast(before) if n["chunks"] <= BROADCAST_ROWS else before, ["shard", "chunk"])
    if base is None:
        start, cut, segments = F.lit(0), F.lit(0), F.lit(0)
    else:
        numbered = numbered.join(F.broadcast(base), "shard", "left")  # a row a shard
        start, cut, segments = (F.coalesce(c, F.lit(0)) for c in ("n", "cut", "segments"))
    numbered = numbered.withColumn("seq", F.col("before") + F.col("seq") + start)
    number = segments + F.floor((F.col("seq") - 1 - cut) / flush_at)
    return numbered.withColumn("segment_no", number.cast("int")).select(*events.columns, "shard", "seq", "segment_no")


def stats(docs: DataFrame, tombstones: DataFrame, by: list[str], built: DataFrame | None = None) -> DataFrame:
    """(*by, n_docs, n_tombstones, tombstone_ratio, live_docs) of the segments of docs(*by, doc_id). tombstones(*by, doc_id)
    count each id once, ids that the segment lacks too, so a ratio may exceed 1; that of an empty segment is 0.
    live_docs is fixed when a segment is built: built(*by, doc_id) has the tombstones that it was built with, none if it
    is not given."""
    out = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    for name, marks in (("n_tombstones", tombstones), ("at_build", built)):
        if marks is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            n = marks.select(*by, "doc_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
            out = out.join(n, by, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    ratio = F.when(F.col("n_docs") > 0, F.col("n_tombstones") / F.col("n_docs")).otherwise(F.lit(0.0))
    return out.select(*by, "n_docs", "n_tombstones", ratio.alias("tombstone_ratio"), (F.col("n_docs") - F.col("at_build")).alias("live_docs"))


def placed_tombstones(docs: DataFrame, deleted: DataFrame, shards: int) -> DataFrame:
    """(shard, segment_no, doc_id): where deleted(doc_id) are recorded: in the segment of docs(shard, segment_no, doc_id)
    that holds the id, else in the last segment of the shard that the id belongs to; nowhere if that has none."""
    marks = deleted.select("doc_id").distinct().withColumn("shard", X.shard_of(F.col("doc_id"), shards))
    held = docs.select("shard", "segment_no", "doc_id")
    last = held.groupBy("shard").agg(F.max("segment_no").alias("last"))  # a row a shard
    found = marks.join(held, ["shard", "doc_id"], "left").join(F.broadcast(last), "shard")
    return found.select("shard", F.coalesce("segment_no", "last").alias("segment_no"), "doc_id")


def pick_merge(segments: DataFrame, by: list[str], ratio: float = TOMBSTONE_RATIO, factor: int = MERGE_FACTOR) -> DataFrame:
    """The rows of segments(*by, position, live_docs, tombstone_ratio) to merge next, in each group of
    `by`: the first whose ratio reaches the limit, and the factor - 1 smallest others; if there is none, the
    factor smallest, or nothing where there are fewer. Equal sizes keep their positions' order."""
    if not 0 <= ratio <= 1 or factor < 2:
        raise ValueError("the ratio must lie between 0 and 1, and the factor be at least 2")
    w = W.partitionBy(*by)
    forced = F.min(F.when(F.col("tombstone_ratio") >= ratio, F.col("position"))).over(w)
    marked = segments.withColumn("forced", forced).withColumn("n", F.count(F.lit(1)).over(w))
    order = w.orderBy(F.when(F.col("position") == F.col("forced"), 0).otherwise(1), "live_docs", "position")
    picked = marked.withColumn("pick", F.row_number().over(order)).where((F.col("pick") <= factor) & (F.col("forced").isNotNull() | (F.col("n") >= factor)))
    return picked.drop("forced", "n")


def compact(docs: DataFrame, picked: DataFrame, tombstones: DataFrame, by: list[str], key: str) -> DataFrame:
    """docs with the picked segments of each group made into one, under their least `key`, without the
    documents deleted in them; other segments are as they were."""
    into = picked.withColumn("into", F.min(key).over(W.partitionBy(*by))).select(*by, key, "into")
    joined = docs.join(F.broadcast(into), [*by, key], "left")  # a row a merged segment
    dead = tombstones.select("doc_id").distinct().withColumn("dead", F.lit(True))
    kept = joined.join(dead, "doc_id", "left").where(F.col("into").isNull() | F.col("dead").isNull())
    return kept.withColumn(key, F.coalesce("into", key)).select(*docs.columns)
