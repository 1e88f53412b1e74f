"""A store of immutable Parquet shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small shards. Compaction takes the shards of a tier (sizes within a factor of
FAN_IN of each other), if there are FAN_IN of them, and merges them into shards of the target size by
reading and writing alone: nothing is shuffled.

A version is a small file that names manifests: Parquet tables with a row for each shard. An append adds one manifest, a
round of compaction writes anew those whose shards it merged; the rest are shared from version to version. A
version is published by a rename that fails if another writer has taken the number, so readers see it whole or not at
all; a writer that comes second takes up the newer version and tries again.

Who writes registers the folder first and takes the entry away after the commit. vacuum leaves registered folders
alone, for EXPIRE_S at least, so it can run beside writers; a writer that finds its files gone at the commit
fails. What neither a version nor an entry names was left by a writer that was lost, and is removed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FAN_IN = 4
ARRIVAL_ROWS = 8000  # rows of an arriving shard
ATTEMPTS = 20  # commits that are tried before a writer gives up
EXPIRE_S = 7 * 24 * 3600  # age from which a registered folder counts as left by a lost writer
MANIFEST = "path string, rows bigint, bytes bigint, files int"


@dataclass(frozen=True)
class Shard:
    path: str  # within the store
    rows: int
    bytes: int
    files: int  # in its folder


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        if target_bytes < 1 or fan_in < 2:
            raise ValueError("target_bytes must be positive and fan_in at least 2")
        self.spark, self.path, self.target_bytes, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        """The committed versions that can be read, ascending."""
        return sorted(self._numbers(".json") - self._numbers(".gone"))

    def _numbers(self, ending: str) -> set[int]:
        return {int(n[1:11]) for n in self._names("versions") if n.startswith("v") and n.endswith(ending)}

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _version(self, version: int | None = None) -> tuple[int, list[str], StructType | None]:
        """(version, its manifests, the schema) of a version, the newest if none is given; 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.path}/versions/v{version:010d}.json"))
        try:
            read = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(read)
        return version, found["manifests"], StructType.fromJson(found["schema"])

    def _shards(self, manifests: list[str]) -> dict[str, list[Shard]]:
        """The shards of each manifest: a row a file of about the target size, and of what waits to be merged."""
        if not manifests:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.path}/manifests/{m}" for m in manifests]).select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("manifest")).collect()
        out: dict[str, list[Shard]] = {m: [] for m in manifests}
        for r in rows:
            out[r["manifest"]].append(Shard(r["path"], r["rows"], r["bytes"], r["files"]))
        return out

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], StructType | None]:
        """(version, its shards, the schema) of a version, the newest if none is given."""
        version, manifests, schema = self._version(version)
        return version, [s for own in self._shards(manifests).values() for s in own], schema

    def _write_manifest(self, shards: list[Shard]) -> str:
        name = uuid.uuid4().hex
        rows = [(s.path, s.rows, s.bytes, s.files) for s in shards]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        return name

    def _commit(self, version: int, manifests: list[str], schema: StructType) -> int:
        """Publish `version`, unless another writer has."""
        text = json.dumps({"version": version, "manifests": manifests, "schema": schema.jsonValue()})
        draft, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/v{version:010d}.json")
        stream = self._fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} of {self.path} was committed by another writer") from e
            raise
        return version

    def _publish(self, folders: list[str], change: Callable[[list[str], StructType | None], tuple[list[str], StructType]]) -> int:
        """Commit what `change` makes of the newest version's manifests, again and again until no other writer was
        faster; folders are those that the change adds, which must still be there."""
        for attempt in range(ATTEMPTS):
            version, manifests, schema = self._version()
            manifests, schema = change(manifests, schema)
            for f in folders:
                if not self._fs.exists(self._path(f"{self.path}/{f}")):
                    raise RuntimeError(f"{f} was removed before its commit, as if its writer were lost")
            try:
                return self._commit(version + 1, manifests, schema)
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(0.05 * attempt)

    # --- writing

    def _register(self) -> str:
        """The name of a new folder, registered as being written."""
        name = uuid.uuid4().hex
        self._fs.create(self._path(f"{self.path}/writing/{name}"), False).close()
        return name

    def _done(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/writing/{name}"), False)

    def _write(self, df: DataFrame, name: str, most_rows: int = 0) -> list[Shard]:
        """Write df as new shards, in the registered folder of that name, that no version names yet."""
        folder = f"data/{name}"
        df.write.option("maxRecordsPerFile", most_rows).parquet(f"{self.path}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet")}
        files = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count()  # from the footers
        rows = {r["f"]: r["count"] for r in files.collect()}  # a row a file, as the manifest has
        full = [n for n in sorted(sizes) if rows.get(n)]
        return [Shard(f"{folder}/{n}", rows[n], sizes[n], len(sizes)) for n in full]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Add the rows of df as shards of at most so many rows; returns the new version. The schema must
        be that of the store. An empty df gives a version with the same shards. Writers may append at the same time."""

        def fits(schema: StructType | None) -> StructType:
            if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError("the schema differs from the store's")
            return schema or df.schema

        fits(self._version()[2])
        name = self._register()
        try:
            shards = self._write(df, name, rows)
            own = [self._write_manifest(shards)] if shards else []
            return self._publish([f"data/{name}", *(f"manifests/{m}" for m in own)], lambda manifests, schema: (manifests + own, fits(schema)))
        finally:
            self._done(name)

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """The shards below the target size, by the power of fan_in that their size reaches."""
        out: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes <= self.target_bytes:
                out.setdefault(int(math.log(max(s.bytes, 1), self.fan_in) + 1e-9), []).append(s)
        return out

    def compact(self) -> int:
        """Merge tiers until none has fan_in shards, one version for each round of merges; returns the
        newest version. A round whose shards another writer has merged meanwhile is given up and made anew. Older
        versions can be read until vacuum removes them."""
        while True:
            version, manifests, schema = self._version()
            own = self._shards(manifests)
            due = [t for t in self.tiers([s for shards in own.values() for s in shards]).values() if len(t) >= self.fan_in]
            if not due:
                return version
            names, merged = [], []
            try:
                for tier in due:
                    total = sum(s.bytes for s in tier)
                    n = max(1, min(round(total / self.target_bytes), len(tier) // 2))
                    names.append(self._register())
                    merged += self._write(self.spark.read.schema(schema).parquet(*self._paths(tier)).coalesce(n), names[-1])
                gone = {s.path for t in due for s in t}
                touched = {m for m, shards in own.items() if any(s.path in gone for s in shards)}
                added = [self._write_manifest([s for m in touched for s in own[m] if s.path not in gone] + merged)]

                def change(now: list[str], schema: StructType | None) -> tuple[list[str], StructType]:
                    if not touched <= set(now):
                        raise _Overtaken
                    return [m for m in now if m not in touched] + added, schema

                self._publish([f"data/{n}" for n in names] + [f"manifests/{m}" for m in added], change)
            except _Overtaken:
                pass
            finally:
                for n in names:
                    self._done(n)

    def vacuum(self, versions: int = 1, expire_s: float = EXPIRE_S) -> None:
        """Remove all but the newest `versions` versions, and every manifest and shard that none of them names. Readers of
        older versions must have ended. What writers have registered stays, unless that was expire_s ago."""
        # a folder that is there now was registered before; if it is no longer registered then, its version is committed
        data, manifests = self._names("data"), self._names("manifests")
        young = self.spark._jvm.java.lang.System.currentTimeMillis() - expire_s * 1000
        where = self._path(f"{self.path}/writing")
        entries = list(self._fs.listStatus(where)) if self._fs.exists(where) else []
        writing = {e.getPath().getName() for e in entries if e.getModificationTime() >= young}
        kept = self.versions()[-max(1, versions) :]
        named = {m for v in kept for m in self._version(v)[1]}
        shards = {s.path for own in self._shards(sorted(named)).values() for s in own}
        for v in self._numbers(".json") if kept else ():
            if v < kept[0]:
                self._retire(v, young)
        if not writing:  # a writer's manifest is not registered by name
            for m in set(manifests) - named:
                self._fs.delete(self._path(f"{self.path}/manifests/{m}"), True)
        folders = {p.split("/")[1] for p in shards}
        for folder in set(data) - writing - folders:
            self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
        for folder in set(data) & folders - writing:
            for f in self._names(f"data/{folder}"):
                if f"data/{folder}/{f}" not in shards:
                    self._fs.delete(self._path(f"{self.path}/data/{folder}/{f}"), True)
        for e in entries:
            if e.getPath().getName() not in writing:
                self._fs.delete(e.getPath(), False)

    def _retire(self, version: int, young: float) -> None:
        """Mark a version as gone. Its file stays for a while: a writer that is late must not find the number free."""
        path = f"{self.path}/versions/v{version:010d}"
        mark = self._path(f"{path}.gone")
        if not self._fs.exists(mark):
            self._fs.create(mark, True).close()
        if self._fs.getFileStatus(self._path(f"{path}.json")).getModificationTime() < young:
            self._fs.delete(self._path(f"{path}.json"), False)
            self._fs.delete(mark, False)

    # --- reading

    def _paths(self, shards: list[Shard]) -> list[str]:
        """What to read for the shards: folders of which all files are theirs, and else the files."""
        by: dict[str, list[Shard]] = {}
        for s in shards:
            by.setdefault(s.path.rpartition("/")[0], []).append(s)
        return [f"{self.path}/{p}" for folder, own in by.items() for p in ([folder] if len(own) == own[0].files else [s.path for s in own])]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        version, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("nothing was appended yet")
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(shards))


class _Overtaken(Exception):
    """Another writer has merged the same shards."""


def sharded(arrivals: list[DataFrame], path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, arrival_rows: int = ARRIVAL_ROWS) -> tuple[ShardStore, int]:
    """(a store at path to which the arrivals were appended one by one, compacted after each; the shards appended).

    Rows go through as they are: nulls in any column, empty and very long texts, repeated rows, and
    columns of any name. An empty table stays empty, with its schema. The store is new, and nothing else
    reads or writes it meanwhile: what compaction has replaced is removed each time."""
    store, appended = ShardStore(arrivals[0].sparkSession, path, target_bytes, fan_in), 0
    for df in arrivals:
        before = len(store.manifest()[1])
        store.append(df, arrival_rows)
        appended += len(store.manifest()[1]) - before
        store.compact()
        store.vacuum()
    return store, appended
