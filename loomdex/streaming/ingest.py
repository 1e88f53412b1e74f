"""Streaming ingest: document events arrive in micro-batches, are routed to shards and numbered, and every
flush_at events of a shard become a visible segment, wherever the micro-batches end.

Each micro-batch writes its own folder, overwriting what a failed attempt left, and takes its starting
numbers from the batch before it; so a batch that is run again gives the same segments. A commit by hand closes
the segments that are open: it is a folder of its own, named by the batch it follows, and those that come after begin new
segments. A folder counts once it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators import segments
from loomdex.plans import search
from loomdex.sources.index import StoredIndex, segment_id
from loomdex.sources.storage import exists, names

STATE = "shard int, n bigint, cut bigint, segments bigint"


class StreamIndexer:
    def __init__(self, spark: SparkSession, path: str, shards: int, flush_at: int) -> None:
        if flush_at < 1:
            raise ValueError("flush_at must be positive")
        self.spark, self.path, self.shards, self.flush_at = spark, path.rstrip("/"), shards, flush_at

    def _last(self, what: str, before: int | None) -> int | None:
        """The last complete batch, or commit, before a batch."""
        found = [int(n.rpartition("=")[2]) for n in names(self.spark, f"{self.path}/{what}") if "=" in n]
        found = [k for k in found if (before is None or k < before) and exists(self.spark, f"{self.path}/{what}/batch={k}/_SUCCESS")]
        return max(found, default=None)

    def _state(self, before: int | None = None) -> DataFrame:
        """(shard, n, cut, segments) of the shards that have had an event, in the batches before one: events accepted, how
        many of them when segments were last closed by hand, and how many segments there were then."""
        batch, commit = self._last("counts", before), self._last("commits", before)
        if batch is None:
            return self.spark.createDataFrame([], STATE)
        state = self.spark.read.schema("shard int, n bigint").parquet(f"{self.path}/counts/batch={batch}")
        if commit is None:
            return state.select("shard", "n", F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("segments"))
        cuts = self.spark.read.schema("shard int, cut bigint, segments bigint").parquet(f"{self.path}/commits/batch={commit}")
        return state.join(F.broadcast(cuts), "shard", "left").select("shard", "n", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("segments", F.lit(0)).alias("segments"))  # a row a shard

    def accept(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch. Events with a null or negative id fail it, and so does an indexer that is sealed."""
        if self.sealed():
            raise ValueError("the indexer is sealed")
        spark = batch.sparkSession
        if not batch.where("doc_id is null or doc_id < 0").isEmpty():
            raise ValueError("an event needs a doc_id of 0 or more")
        before = self._state(batch_id)
        where = f"{self.path}/events/batch={batch_id}"
        segments.assign(batch, self.shards, self.flush_at, before).write.mode("overwrite").parquet(where)
        own = spark.read.parquet(where).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        counts = before.select("shard", "n").unionByName(own).groupBy("shard").agg(F.sum("n").alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take everything that is there now, and return."""
        query = stream.writeStream.foreachBatch(self.accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def commit_all(self) -> None:
        """Make what is pending visible as a last, short segment of each shard; what follows begins a new one."""
        batch = self._last("counts", None)
        where = f"{self.path}/commits/batch={batch}"
        if batch is None or exists(self.spark, f"{where}/_SUCCESS"):
            return
        state = self._state().select("shard", F.col("n").alias("cut"), (F.col("segments") + F.ceil((F.col("n") - F.col("cut")) / self.flush_at)).alias("segments"))
        state.coalesce(1).write.mode("overwrite").parquet(where)

    def seal(self) -> None:
        """Take no more events."""
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/sealed")

    def sealed(self) -> bool:
        return exists(self.spark, f"{self.path}/sealed/_SUCCESS")

    def visible(self) -> DataFrame:
        """The events of full segments, and of those closed by hand."""
        upto = self._state().select("shard", (F.col("cut") + F.floor((F.col("n") - F.col("cut")) / self.flush_at) * self.flush_at).alias("upto"))
        events = self.spark.read.option("basePath", f"{self.path}/events").parquet(*self._complete()).drop("batch")
        return events.join(F.broadcast(upto), "shard").where(F.col("seq") <= F.col("upto")).drop("upto")  # a row a shard

    def _complete(self) -> list[str]:
        """The folders of the batches that were counted."""
        return [f"{self.path}/events/{n}" for n in names(self.spark, f"{self.path}/counts") if exists(self.spark, f"{self.path}/counts/{n}/_SUCCESS")]

    def status(self) -> DataFrame:
        """(shard, accepted, segments, pending) of each shard that has had an event."""
        open_ = F.col("n") - F.col("cut")
        return self._state().select("shard", F.col("n").alias("accepted"), (F.col("segments") + F.floor(open_ / self.flush_at)).alias("segments"), (open_ % self.flush_at).alias("pending"))


class SearchCluster:
    """Events from a stream to an index that can be searched: ingest, commit, delete, merge, search."""

    def __init__(self, spark: SparkSession, path: str, book, shards: int, flush_at: int) -> None:
        self.indexer = StreamIndexer(spark, f"{path}/stream", shards, flush_at)
        self.index = StoredIndex(spark, f"{path}/index", book, shards)

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch of events and index the segments that it fills."""
        self.indexer.accept(batch, batch_id)
        self.publish()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Ingest everything that is there now, and return."""
        query = stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def commit_all(self) -> None:
        self.indexer.commit_all()
        self.publish()

    def publish(self) -> None:
        """Index the visible segments that the index does not list yet."""
        known = self.index._listing().select("segment")
        new = self.indexer.visible().withColumn("segment", segment_id(F.col("shard"), F.col("segment_no"))).join(F.broadcast(known), "segment", "left_anti").drop("segment")  # a row a segment
        if not new.isEmpty():
            self.index.flush(new)

    def tombstone(self, ids: DataFrame) -> None:
        self.index.delete(ids)

    def merge(self, ratio: float = segments.TOMBSTONE_RATIO, factor: int = segments.MERGE_FACTOR) -> bool:
        return self.index.merge(ratio, factor)

    def live_segment_count(self) -> int:
        """The shards that have a segment."""
        return self.index.listed("latest").count()

    def search(self, queries: DataFrame, visibility: str = "all") -> DataFrame:
        return search.stored_search(self.index, queries, visibility)


def parquet_stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = 4) -> DataFrame:
    """A file stream over a table of a data folder, one file or many, so many of them a micro-batch: None for all that
    there are. Files come in the order of their times, whatever ids they hold."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _stream_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_stream(spark, sf_dir, "documents").select("doc_id", X.terms(F.col("text")).alias("content_terms"), F.concat(F.lit("group_"), "source").alias("acl"))


def status_of_stream(spark: SparkSession, sf_dir: str, path: str, shards: int, flush_at: int) -> DataFrame:
    """The status after streaming all documents of a data folder into an indexer at path."""
    indexer = StreamIndexer(spark, path, shards, flush_at)
    indexer.run(_stream_of_documents(spark, sf_dir), f"{path}/checkpoint")
    return indexer.status()


def status_after_commit(spark: SparkSession, sf_dir: str, path: str, shards: int, flush_at: int) -> DataFrame:
    """The status after streaming the documents of even ids, a commit, and the documents of odd ids."""
    indexer = StreamIndexer(spark, path, shards, flush_at)
    taken = 0
    for parity in (0, 1):
        own = _stream_of_documents(spark, sf_dir).where(F.col("doc_id") % 2 == parity)
        query = own.writeStream.foreachBatch(lambda batch, k, first=taken: indexer.accept(batch, first + k)).option("checkpointLocation", f"{path}/checkpoint-{parity}").trigger(availableNow=True).start()
        query.awaitTermination()
        taken = (indexer._last("counts", None) or 0) + 1
        if not parity:
            indexer.commit_all()
    return indexer.status()
