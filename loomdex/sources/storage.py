"""Where the engine keeps its own tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which every executor sees; in local mode a
    temporary folder serves if the setting is missing."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="loomdex-engine-"))
        found = f"file://{_OWN[0]}"
    return f"{found.rstrip('/')}/engine/{what}-{uuid.uuid4().hex}"


#: Rows of a narrow table up to which it is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is. It is counted, as far as that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Narrow rows that one task has after a shuffle, about.
TASK_ROWS = 1 << 20


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """In how many parts rows are shuffled, so that a task has about `each` of them however many there are. Parts that
    are left to the session are of a fixed number, or of a size that is measured in compressed rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
