"""Numbered snapshots of a table. Data goes to a folder of its own first; one small log entry then makes it a
version, so a version never points at nothing. Of two writers that choose the same number, the one whose entry
exists first has it; the other gets an error, and its data is nobody's. A pointer names the current version:
every new one, or an older one that point_to() goes back to. All of it goes through Hadoop's file systems,
wherever the folder is.

A version is a base and layers on it. An append writes what it changes as one more layer, whose rows take the
place of those with their keys below; reading puts them together. When layers get many or large against their base, the
next append writes a base again. A base with a key lies in buckets of the key, each with a checksum that doesn't
depend on the order of rows, so two versions are compared by reading only what can differ.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import merge as merging
from lodestone.operators.merge import merge
from lodestone.sources.tables import parquet


@dataclass
class Version:
    version: int
    timestamp: str
    path: str
    record_count: int
    manifest_hash: str | None = None
    append_mode: bool = False
    merge_strategy: str | None = None
    records_added: int | None = None
    records_updated: int | None = None
    parent_version: int | None = None
    key: str | None = None
    unique: bool = False
    buckets: int | None = None
    layers: list[str] = field(default_factory=list)
    layer_rows: int = 0
    removed: bool = False


class VersionTaken(ValueError):
    """Another writer has the number."""


LOG = "version int, timestamp string, path string, record_count long, manifest_hash string, append_mode boolean, merge_strategy string, records_added long, records_updated long, parent_version int, key string, unique boolean, buckets int, layers array<string>, layer_rows long, removed boolean"
#: Layers on a base, and their rows as a share of the base's, beyond which a base is written again; rows of a bucket.
MOST_LAYERS, MOST_SHARE, BUCKET_ROWS = 8, 0.25, 1_000_000


def identity(df: DataFrame) -> str:
    """A hash of all rows of df, whatever their order and partitions: rows are hashed and equal ones counted, hashes
    of a range hashed in order, and so on up a tree of three levels. A row or count that differs makes another hash."""
    row = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    level = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n")).select("h", F.concat_ws(":", "h", "n").alias("v"))
    for digits in (4, 2):
        joined = F.array_join(F.array_sort(F.collect_list("v")), ",")
        level = level.groupBy(F.left("h", F.lit(digits)).alias("h")).agg(F.sha2(joined, 256).alias("d")).select("h", F.concat_ws("=", "h", "d").alias("v"))
    top = sorted(r["v"] for r in level.select("v").collect())  # one for each two digits: 256 at most
    return "sha256:" + hashlib.sha256(",".join(top).encode()).hexdigest()


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        """The path for Hadoop, and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, entry: dict) -> None:
        """A small file that must not exist yet."""
        at, fs = self._path(path)
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                raise VersionTaken(f"{path} exists") from None
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _entries(self, kind: str, schema: str) -> DataFrame:
        at, fs = self._path(f"{self.root}/{kind}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/{kind}")

    def log(self) -> DataFrame:
        """All versions that exist, in order; the last entry of a version counts."""
        last = self._entries("_log", LOG).groupBy("version").agg(F.max_by(F.struct(*[f.name for f in fields(Version)]), "removed").alias("v"))
        return last.select("v.*").where(~F.col("removed")).orderBy("version")

    def versions(self) -> list[Version]:
        return [Version(**r.asDict()) for r in self.log().collect()]

    def current(self) -> int:
        """The version that the pointer names last, of those that exist; 0 before the first."""
        there = {v.version for v in self.versions()}
        named = self._entries("_pointer", "seq int, version int").where(F.col("version").isin(sorted(there))).orderBy(F.desc("seq")).first() if there else None
        return named["version"] if named else max(there, default=0)

    def point_to(self, version: int) -> None:
        """Make a version current. The pointer's entries are numbered; each is written once, by one writer."""
        if self.info(version) is None:
            raise ValueError(f"no version {version}")
        seq = (self._entries("_pointer", "seq int, version int").agg(F.max("seq")).first()[0] or 0) + 1
        while True:
            try:
                return self._put(f"{self.root}/_pointer/{seq:08d}.json", {"seq": seq, "version": version})
            except VersionTaken:
                seq += 1

    def info(self, version: int) -> Version | None:
        return next((v for v in self.versions() if v.version == version), None)

    def _record(self, v: Version, name: str) -> None:
        self._put(f"{self.root}/_log/{name}.json", asdict(v))

    def create(self, df: DataFrame, version: int | None = None, manifest: DataFrame | None = None, append_mode: bool = False, strategy: str | None = None, added: int | None = None, updated: int | None = None, key: str | None = None, unique: bool = False) -> Version:
        """Write df as the next (or a given, unused) version and make it current. Its parent is what was current, in
        append mode. No number is used twice, not even a removed version's. key: what its rows are dealt to buckets
        by, so that versions can be compared bucket by bucket; unique: whether no key has two rows."""
        now = self.current()
        used = {r["version"] for r in self._entries("_log", LOG).select("version").distinct().collect()}
        number = max(used, default=0) + 1 if version is None else version
        if number in used:
            raise VersionTaken(f"version {number} exists")
        path = f"{self.root}/v{number}-{uuid.uuid4().hex}"
        buckets = None
        if key is None:
            df.write.parquet(path)
        else:
            buckets = max(1, -(-df.count() // BUCKET_ROWS))
            df.withColumn("__bucket", _bucket(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
            self._sums(parquet(self.spark, path)).write.parquet(f"{path}-sums")
        digest = None
        if manifest is not None:
            manifest.write.text(f"{path}-manifest")
            digest = identity(manifest)
        v = Version(number, datetime.now(timezone.utc).isoformat(), path, self.spark.read.parquet(path).count(), digest, append_mode, strategy, added, updated, now if append_mode and now else None, key, unique, buckets)
        self._record(v, f"{number:08d}")
        self.point_to(number)
        return v

    @staticmethod
    def _sums(df: DataFrame) -> DataFrame:
        """__bucket, rows and two sums of the rows' hashes that don't depend on their order."""
        columns = sorted(c for c in df.columns if c != "__bucket")
        h = lambda seed: F.xxhash64(F.lit(seed), *columns)
        return df.groupBy("__bucket").agg(F.count("*").alias("rows"), F.sum(h(1).cast("decimal(38,0)")).alias("sum"), F.bit_xor(h(2)).alias("xor"))

    def read(self, version: int | None = None) -> DataFrame:
        """A version's table; the current one by default."""
        v = self.info(self.current() if version is None else version)
        if v is None:
            raise ValueError(f"no version {version}")
        return self._table(v)

    def _table(self, v: Version) -> DataFrame:
        base = parquet(self.spark, v.path).drop("__bucket")
        if not v.layers:
            return base
        changes = self._layers(v.layers, 0)
        newest = changes.groupBy(v.key).agg(F.max("__layer").alias("__newest")).withColumnRenamed(v.key, "__key")
        last = changes.join(newest, F.col(v.key).eqNullSafe(F.col("__key")) & (F.col("__layer") == F.col("__newest"))).drop("__layer", "__newest", "__key")
        return base.join(newest, base[v.key].eqNullSafe(newest["__key"]), "left_anti").unionByName(last, allowMissingColumns=True)

    def _layers(self, paths: list[str], first: int) -> DataFrame:
        parts = [parquet(self.spark, path).withColumn("__layer", F.lit(first + i)) for i, path in enumerate(paths)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        return every

    def append(self, new: DataFrame, key: str, order: str, strategy: str = "update") -> Version:
        """Merge new rows into the current version as operators.merge does, and make the result the next version.

        What is written is the batch's own rows, as a layer, as long as no key of the table has two rows and the layers
        are few and small enough; else the whole table, as a base.
        """
        now = self.info(self.current()) if self.current() else None
        if now is None:
            return self.create(new, append_mode=True, strategy=strategy, added=new.count(), updated=0)
        table = self._table(now)
        merged, n = merge(table, new, key, order, strategy)
        known = now.unique if now.key == key else not now.layers and table.groupBy(key).count().where("count > 1").isEmpty()
        if strategy not in ("update", "skip", "error") or not known:
            one_each = strategy in ("update", "skip")
            return self.create(merged, append_mode=True, strategy=strategy, added=n["added"], updated=n["updated"], key=key if one_each else None, unique=one_each)
        rows = {"update": lambda: merging.update(new.limit(0), new, key, order), "skip": lambda: merging.skip(new.limit(0), new, key, order).join(table.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti"), "error": lambda: new}[strategy]()
        path = f"{self.root}/layer-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        written = parquet(self.spark, path)
        count = written.count()
        unique = strategy != "error" or written.groupBy(key).count().where("count > 1").isEmpty()
        base_rows = now.record_count if not now.layers else parquet(self.spark, now.path).count()
        if len(now.layers) + 1 > MOST_LAYERS or now.layer_rows + count > MOST_SHARE * base_rows:
            whole = Version(0, "", now.path, 0, key=key, layers=[*now.layers, path])
            v = self.create(self._table(whole), append_mode=True, strategy=strategy, added=n["added"], updated=n["updated"], key=key, unique=unique)
            at, fs = self._path(path)
            fs.delete(at, True)
            return v
        used = {r["version"] for r in self._entries("_log", LOG).select("version").distinct().collect()}
        v = Version(max(used) + 1, datetime.now(timezone.utc).isoformat(), now.path, now.record_count + n["added"], None, True, strategy, n["added"], n["updated"], now.version, key, unique, now.buckets, [*now.layers, path], now.layer_rows + count)
        self._record(v, f"{v.version:08d}")
        self.point_to(v.version)
        return v

    def diff(self, old: int, new: int) -> DataFrame:
        """diff() of two versions, of which only what can differ is read: the keys of layers that not both have, or
        buckets whose checksums differ; without either, all."""
        a, b = self.info(old), self.info(new)
        if a is None or b is None:
            raise ValueError(f"no version {old if a is None else new}")
        if a.path == b.path and (key := a.key or b.key):
            same = 0
            while same < min(len(a.layers), len(b.layers)) and a.layers[same] == b.layers[same]:
                same += 1
            rest = [*a.layers[same:], *b.layers[same:]]
            if not rest:
                return diff(self._table(a).limit(0), self._table(b).limit(0))
            keys = self._layers(rest, 0).select(F.col(key).alias("__key")).distinct()
            only = lambda v: (t := self._table(v)).join(keys, t[key].eqNullSafe(keys["__key"]), "left_semi")
            return diff(only(a), only(b))
        if a.key and a.key == b.key and a.buckets == b.buckets and not a.layers and not b.layers:
            sums = [parquet(self.spark, f"{v.path}-sums") for v in (a, b)]
            unequal = sums[0].exceptAll(sums[1]).unionByName(sums[1].exceptAll(sums[0])).select("__bucket").distinct()
            numbers = [r["__bucket"] for r in unequal.collect()]  # one for each bucket
            return diff(*(parquet(self.spark, v.path).where(F.col("__bucket").isin(numbers)).drop("__bucket") for v in (a, b)))
        return diff(self._table(a), self._table(b))

    def keep_last(self, n: int) -> list[int]:
        """Remove all but the last n versions and the current one: each is forgotten first, then its data goes, so
        none that is listed lacks data. Returns their numbers."""
        if n < 1:
            raise ValueError("at least one version must be kept")
        current = self.current()
        gone = [v for v in self.versions()[:-n] if v.version != current]
        for v in gone:
            v.removed = True
            self._record(v, f"{v.version:08d}-removed")
            needed = {path for other in self.versions() for path in (other.path, *other.layers)}
            for path in (v.path, *v.layers):
                for name in (path, f"{path}-manifest", f"{path}-sums") if path not in needed else ():
                    at, fs = self._path(name)
                    fs.delete(at, True)
        return [v.version for v in gone]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with repeats, and change (added or removed)."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
