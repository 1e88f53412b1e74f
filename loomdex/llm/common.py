"""What the corpus operators share: the cluster's shared folder, tables written to cut lineage, and
column names that cannot clash."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary
    one, but in local mode only: on a cluster the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="loomdex-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/loomdex/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor
    loses nothing of it. discard() deletes it once nothing reads it any more."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize has written and that no result will read."""
    for t in tables:
        delete_path(t.sparkSession, t.written_to)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with the file system it lies on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """base, or base with a suffix that no column of df has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of id columns up to which a side of a join is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


#: Bytes of rows that go to a Python worker at once: texts can be long, and the default is by row.
BATCH_BYTES = 8 << 20


def release() -> None:
    """Give the system back what a batch of texts has taken and freed: Python workers are kept for the next task, and
    several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that the session sends to Python by BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a written table of ids, if it has at most so many rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, and all rows without one. Of rows that repeat a doc_id that with the
    greatest text (then source) is taken, so that every evaluation takes the same. Texts move only if some doc_id
    repeats."""
    again = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs
    by = [quoted(c) for c in ("text", "source") if c in docs.columns]
    picked = F.max_by(F.struct(*map(quoted, docs.columns)), F.struct(*by)).alias("picked")
    once = docs.join(small_side(again), "doc_id", "left_semi").groupBy("doc_id").agg(picked).select("picked.*")
    return docs.join(small_side(again), "doc_id", "left_anti").select(*map(quoted, docs.columns)).unionByName(once)


#: A key is heavy from this share of all rows on, and this many of them.
HEAVY_SHARE, HEAVY_ROWS = 1024, 100_000


def heavy_keys(df: DataFrame, key: str) -> list[int]:
    """The values of a bigint column that so many rows have that one task should not have them all: HEAVY_SHARE at
    most, from summaries of fixed size that each task makes of its rows. Other values may be among them."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {HEAVY_SHARE}, {16 * HEAVY_SHARE})").alias("top")).first()
    return [t["item"] for t in got["top"] if t["item"] is not None and t["count"] >= max(got["n"] / HEAVY_SHARE, HEAVY_ROWS)]


def with_aggregates(df: DataFrame, key: str, by: list[str], **aggregates: tuple[str, str]) -> DataFrame:
    """df with a column for each of aggregates, name=(function, column), over the rows that agree in `by`; key: one of
    them, a bigint. Groups of heavy keys are aggregated where their rows lie, which do not move; those of
    others meet in a task each."""
    made = {name: getattr(F, f)(column) for name, (f, column) in aggregates.items()}
    heavy = heavy_keys(df, key)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    rest = df.where(~is_heavy) if heavy else df
    for name, a in made.items():
        rest = rest.withColumn(name, a.over(W.partitionBy(*by)))
    if not heavy:
        return rest
    own = df.where(is_heavy)
    totals = own.groupBy(*by).agg(*[a.alias(name) for name, a in made.items()])
    return rest.unionByName(own.join(small_side(materialize(totals, "heavy")), by))
