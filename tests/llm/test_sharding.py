"""The shard store: rows, tiers, versions, writers that are lost or late."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdex.llm.common import fresh_path
from loomdex.llm.queries import op1_tiered_sharding
from loomdex.llm.sharding import Conflict, ShardStore, sharded


def _rows(df):
    return Counter(map(tuple, df.collect()))


def test_compaction_keeps_the_rows_and_merges_like_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = 200_000
    store = ShardStore(spark, fresh_path(spark, "store"), target_bytes=target, fan_in=3)
    store.append(docs, rows=5)
    before = store.manifest()[1]
    assert max(s.rows for s in before) <= 5 and sum(s.rows for s in before) == docs.count()
    store.compact()
    _, after, _ = store.manifest()
    assert sum(s.rows for s in after) == docs.count() and len(after) < len(before) / 3
    assert all(len(t) < 3 for t in store.tiers(after).values())
    # a shard is at most about twice the target, unless a single row is larger
    assert all(s.bytes < 3 * target or s.rows == 1 for s in after)
    assert _rows(store.read()) == _rows(docs)


def test_versions_can_be_read_until_vacuumed(spark):
    store = ShardStore(spark, fresh_path(spark, "store"), fan_in=2)
    first, second = spark.range(10), spark.range(10, 30)
    assert store.append(first) == 1 and store.append(second) == 2
    assert store.compact() > 2
    assert _rows(store.read(1)) == _rows(first) and _rows(store.read(2)) == _rows(store.read()) == _rows(first.union(second))
    store.vacuum(versions=2)
    assert len(store.versions()) == 2 and _rows(store.read(store.versions()[0])) == _rows(first.union(second))
    store.vacuum()
    assert len(store.versions()) == 1 and _rows(store.read()) == _rows(first.union(second))
    assert len(store._names("data")) == len({s.path.split("/")[1] for s in store.manifest()[1]}) and len(store._names("manifests")) == 1


def test_a_late_writer_takes_up_the_newer_version(spark, monkeypatch):
    """Of two writers, the one whose commit comes second commits after the other; one that never gets through fails."""
    path = fresh_path(spark, "store")
    one, two = ShardStore(spark, path), ShardStore(spark, path)
    one.append(spark.range(5))
    real, stale = two._version, two._version()
    one.append(spark.range(5, 9))
    calls = iter([stale, stale])
    monkeypatch.setattr(two, "_version", lambda version=None: next(calls, None) or real(version))
    assert two.append(spark.range(100, 103)) == 3
    assert _rows(one.read()) == _rows(spark.range(9).union(spark.range(100, 103)))
    monkeypatch.setattr(two, "_version", lambda version=None: stale)
    with pytest.raises(Conflict):
        two.append(spark.range(100, 200))
    assert one.read().count() == 12 and not one._names("writing")


def test_vacuum_beside_a_writer(spark, monkeypatch):
    """Vacuum and compaction while a writer is between its write and its commit lose nothing of it."""
    path = fresh_path(spark, "store")
    store, other = ShardStore(spark, path, fan_in=2), ShardStore(spark, path, fan_in=2)
    store.append(spark.range(5))
    real = store._commit

    def commit(*args):
        monkeypatch.setattr(store, "_commit", real)
        other.append(spark.range(50, 60))
        other.compact()
        other.vacuum()
        return real(*args)

    monkeypatch.setattr(store, "_commit", commit)
    store.append(spark.range(5, 9))
    store.vacuum()
    assert _rows(store.read()) == _rows(spark.range(9).union(spark.range(50, 60)))


def test_compaction_beside_a_writer(spark, monkeypatch):
    path = fresh_path(spark, "store")
    store, other = ShardStore(spark, path, fan_in=2), ShardStore(spark, path, fan_in=2)
    store.append(spark.range(5))
    store.append(spark.range(5, 9))
    real = store._commit

    def commit(*args):
        monkeypatch.setattr(store, "_commit", real)
        other.append(spark.range(50, 60))
        other.compact()  # merges what `store` is merging
        return real(*args)

    monkeypatch.setattr(store, "_commit", commit)
    store.compact()
    assert _rows(store.read()) == _rows(spark.range(9).union(spark.range(50, 60)))
    assert all(len(t) < 2 for t in store.tiers(store.manifest()[1]).values())


def test_a_writer_that_was_taken_for_lost_fails(spark, monkeypatch):
    store = ShardStore(spark, fresh_path(spark, "store"))
    store.append(spark.range(5))
    real = store._write_manifest

    def write(shards):
        store.vacuum(expire_s=-10)
        return real(shards)

    monkeypatch.setattr(store, "_write_manifest", write)
    with pytest.raises(RuntimeError, match="removed"):
        store.append(spark.range(50, 60))
    assert _rows(store.read()) == _rows(spark.range(5))


def test_files_without_a_manifest_are_not_read(spark):
    store = ShardStore(spark, fresh_path(spark, "store"))
    store.append(spark.range(5))
    store._write(spark.range(50, 60), store._register())  # a writer lost before its commit
    assert _rows(store.read()) == _rows(spark.range(5))
    store.vacuum()
    assert len(store._names("data")) == 2  # it might live
    store.vacuum(expire_s=-10)
    assert len(store._names("data")) == 1 and not store._names("writing") and _rows(store.read()) == _rows(spark.range(5))


def test_the_query_shows_whether_shards_were_merged(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op1_tiered_sharding(spark, sf_dir)
    assert rows.count() == docs.count() and {(r["merged"], r["tiers_due"]) for r in rows.collect()} == {(True, 0)}
    monkeypatch.setattr(ShardStore, "compact", lambda self: 0)
    assert {(r["merged"], r["tiers_due"] > 0) for r in op1_tiered_sharding(spark, sf_dir).collect()} == {(False, True)}


def test_table_cases(spark):
    rows = [(1, None, None), (None, "", 2), (2, "long " * 100_000, 3), (2, "tie", 3), (2, "tie", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `shard` int").withColumn("path", F.lit("x")).withColumn("_metadata_2", F.lit(1))
    store, appended = sharded([docs, docs], fresh_path(spark, "store"), fan_in=2, arrival_rows=1)
    assert appended == 10 and store.read().columns == docs.columns and _rows(store.read()) == _rows(docs.union(docs))
    empty = sharded([docs.limit(0)], fresh_path(spark, "store"))[0].read()
    assert empty.count() == 0 and empty.columns == docs.columns
    store = ShardStore(spark, fresh_path(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    store.append(docs)
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    for bad in ({"target_bytes": 0}, {"fan_in": 1}):
        with pytest.raises(ValueError):
            ShardStore(spark, "x", **bad)
