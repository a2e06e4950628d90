"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable Parquet shards.  Compaction puts shards into
tiers by size, merges runs of similarly sized ones of a tier into one file of at most
the target size, and commits the new list of shards.  A manifest is one JSON file per
version; a commit writes a temporary file and renames it to the next version's name,
which fails if another writer was first.  Readers see a whole version or the one before,
whose files stay until a later vacuum.

The table's schema is the union of all arrivals' columns: a column that an arrival lacks is
null in its rows.  Names are compared without regard to case; a name that comes back with
another type is refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class Conflict(RuntimeError):
    """Another writer committed a version, or removed a shard, that this commit needs."""


def united(old: StructType | None, new: StructType) -> StructType:
    """The columns of both, the old ones first, all nullable; a ValueError where one name has two types."""
    fields = {f.name.lower(): StructField(f.name, f.dataType, True) for f in (old.fields if old else ())}
    for f in new.fields:
        have = fields.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
        if have.dataType != f.dataType:
            raise ValueError(f"{f.name} is {have.dataType.simpleString()} in the table and {f.dataType.simpleString()} in the arrival")
    return StructType(list(fields.values()))


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def tier(size: int, smallest: int, fan_in: int) -> int:
    """0 up to ``smallest`` bytes, one more for each factor of ``fan_in``."""
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, fan_in))


def plan(shards: list[Shard], target: int, smallest: int, fan_in: int, flush: bool = False) -> list[list[Shard]]:
    """Groups to merge: runs of shards of one tier, in order of size, of at most ``target`` bytes together.

    A tier merges once it holds ``fan_in`` shards under the target, or whenever
    ``flush`` is set, which also puts neighbouring tiers together.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if 2 * s.bytes <= target:  # over half the target: finished, two never fit one file
            tiers.setdefault(0 if flush else tier(s.bytes, smallest, fan_in), []).append(s)
    out = []
    for _, members in sorted(tiers.items()):
        if len(members) < (2 if flush else fan_in):
            continue
        group: list[Shard] = []
        total = 0
        for s in members:
            if group and total + s.bytes > target:
                out.append(group)
                group, total = [], 0
            group.append(s)
            total += s.bytes
        out.append(group)
    return [g for g in out if len(g) > 1]


class ShardStore:
    """A table of immutable shards under ``root``; every state is a manifest version.

    Rows pass through unchanged: nulls, repeated rows, very long texts and any columns (by
    their unique names) are kept, a column that was once there for good; an empty arrival
    commits a version without new shards, and its columns.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, smallest: int = 4 << 20, fan_in: int = 4, wave: int = 256):
        self.spark, self.root, self.target, self.smallest, self.fan_in, self.wave = spark, root, target, smallest, fan_in, wave
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    # manifests
    def versions(self) -> list[int]:
        d = self._path(f"{self.root}/_manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(d)] if self._fs.exists(d) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; version 0 has no shards."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.text(f"{self.root}/_manifests/v{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def schema(self, manifest: dict) -> StructType | None:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None

    def commit(self, add: list[Shard], remove: list[Shard], schema: StructType, tries: int = 5) -> int:
        """Commits the next version atomically, with the columns of ``schema`` besides those that are there; rebases on versions that others committed meanwhile."""
        gone = {s.path for s in remove}
        for _ in range(tries):
            now = self.manifest()
            here = {s["path"] for s in now["shards"]}
            if not gone <= here:
                raise Conflict("a shard to be replaced isn't in the last version")
            body = {"version": now["version"] + 1, "schema": united(self.schema(now), schema).json(), "shards": [s for s in now["shards"] if s["path"] not in gone] + [asdict(s) for s in add]}
            temporary = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
            out = self._fs.create(temporary, False)
            out.write(json.dumps(body).encode())
            out.close()
            if self._rename(temporary, self._path(f"{self.root}/_manifests/v{body['version']:012d}.json")):
                return body["version"]
            self._fs.delete(temporary, False)
        raise Conflict("other writers were first each time")

    def _rename(self, source, to) -> bool:
        from py4j.protocol import Py4JJavaError

        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(source, to, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    # data
    def _write(self, df: DataFrame) -> list[Shard]:
        """Writes a folder of new shards and lists them, by footers alone."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        read = self.spark.read.schema(df.schema).parquet(folder)
        meta = read.metadataColumn("_metadata")
        listed = read.groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).agg(F.count("*").alias("rows")).collect()
        return sorted((Shard(r["path"], r["bytes"], r["rows"]) for r in listed), key=lambda s: s.path)

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as it is partitioned: one small shard for each partition.  Its columns may be others than the table's."""
        united(self.schema(self.manifest()), df.schema)  # refuse before anything is written
        return self.commit(self._write(df), [], df.schema)

    def compact(self, flush: bool = False) -> int:
        """Merges until no tier is full; returns the version.

        Each merged file is written by one task that streams its group's shards: no
        shuffle, and memory for one batch.  Old shards stay until ``vacuum``.
        """
        now = self.manifest()
        while groups := plan([Shard(**s) for s in now["shards"]], self.target, self.smallest, self.fan_in, flush):
            schema = self.schema(now)
            for k in range(0, len(groups), self.wave):
                some = groups[k : k + self.wave]
                merged = [self.spark.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1) for g in some]
                self.commit(self._write(reduce(DataFrame.unionByName, merged)), [s for g in some for s in g], schema)
            now = self.manifest()
            if flush:
                break
        return now["version"]

    def vacuum(self, keep: int = 2, orphans_after: float = 86_400.0) -> int:
        """Deletes shards that none of the last ``keep`` versions lists, and older manifests; returns how many shards went.

        With ``keep`` 2 a reader of the last version survives one commit and the vacuum after
        it.  Folders that no manifest lists, left by writers that failed, go once they are
        ``orphans_after`` seconds old: a younger one may be about to be committed.
        """
        if keep < 1:
            raise ValueError("the last version stays")
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.shards(v)}
        old = {s.path for v in versions[:-keep] for s in self.shards(v)} - live
        for p in old:
            self._fs.delete(self._path(p), False)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/v{v:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        used = {p.rsplit("/", 2)[-2] for p in live}
        for x in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if x.getPath().getName() not in used and x.getModificationTime() < (time.time() - orphans_after) * 1000:
                self._fs.delete(x.getPath(), True)
        return len(old)

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; ``shard`` names a column with the number of the row's shard in the manifest, with underscores behind it where the table has that name."""
        m = self.manifest(version)
        schema = self.schema(m)
        if schema is None:
            raise ValueError("nothing was ever appended")
        shard = shard and _free(shard, schema.names)
        if not m["shards"]:
            out = self.spark.createDataFrame([], schema)
            return out.withColumn(shard, F.lit(None).cast("int")) if shard else out
        out = self.spark.read.schema(schema).parquet(*[s["path"] for s in m["shards"]])
        if shard is None:
            return out
        at, path = _free("at", [*schema.names, shard]), _free("path", [*schema.names, shard])
        # as many rows as shards: the manifest, which the driver holds anyway
        number = self.spark.createDataFrame([(s["path"], k) for k, s in enumerate(m["shards"])], StructType([StructField(path, StringType()), StructField(shard, IntegerType())]))
        if len(m["shards"]) <= 100_000:  # some ten megabytes; beyond that the join is planned by size
            number = F.broadcast(number)
        name = out.metadataColumn("_metadata")["file_path"]
        columns = [F.col(f"`{c}`") for c in out.columns]
        return out.select(*columns, name.alias(at)).join(number, F.col(at) == F.col(path)).select(*columns, F.col(shard))


def arrivals(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """docs as n arrivals by ranges of the id (null ids come first), which a scan can skip to."""
    ids = F.col(f"`{id_col}`")
    cuts = sorted(set(docs.select(ids.cast("double").alias("_id")).stat.approxQuantile("_id", [k / n for k in range(1, n)], 0.01)))
    edges = [None, *[int(c) for c in cuts], None]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = docs
        if a is not None:
            own = own.where(ids > a)
        if b is not None:
            own = own.where((ids <= b) | ids.isNull() if a is None else ids <= b)
        elif a is None:
            own = docs
        out.append(own)
    return out


def shard_documents(docs: DataFrame, root: str, id_col: str = "doc_id", batches: int = 4, **options) -> ShardStore:
    """Appends docs in arrivals, compacting after each, and leaves one version of target-sized files."""
    store = ShardStore(docs.sparkSession, root, **options)
    for some in arrivals(docs, id_col, batches):
        store.append(some)
        store.compact()
        store.vacuum()
    store.compact(flush=True)
    store.vacuum()
    return store
