"""The cache of processed files as a table: lookups, upserts, removals and clean-up.

Parquet takes the place of a binary index: its footer has the checks and the offsets. A version of the table is a
list of part folders in a manifest. A write makes a new part and then a new manifest, created exclusively, so
readers see the old version or the new one, and of two writers at once one is refused. An upsert writes only the new
entries; after COMPACT parts the table is written anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "file_hash string, path string, last_modified long, is_translated boolean, translated_at long, created_at long, cache_mode string, project_fingerprint string, config_hash string"
KEY = ["file_hash", "project_fingerprint", "config_hash"]


def is_valid(entry_mtime: Column, mtime: Column) -> Column:
    return entry_mtime == mtime


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files(file_hash, project_fingerprint, config_hash, ...) with the newest entry of the same
    key, cached_at and cached_mtime; null without one."""
    newest = latest(cache, KEY).select(*KEY, F.col("created_at").alias("cached_at"), F.col("last_modified").alias("cached_mtime"), F.col("is_translated").alias("cached_done"))
    return files.join(newest, KEY, "left")


def latest(cache: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Newest entry per key: greatest created_at, ties by path and hash. Combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in cache.columns])
    order = F.struct("created_at", *[c for c in ("path", "file_hash", "run_id") if c in cache.columns])
    picked = cache.groupBy(*key).agg(F.max_by(row, order).alias("__r"))
    return picked.select("__r.*")


def pending(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files without an entry of the same hash, project and configuration that is translated and has the same mtime."""
    hit = cache.where("is_translated").select(*KEY, F.col("last_modified").alias("mtime")).distinct()
    return files.join(hit, [*KEY, "mtime"], "left_anti")


def orphans(cache: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries whose hash no existing file has."""
    return cache.join(existing.select("file_hash").distinct(), "file_hash", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("path").alias("paths"), F.sum(F.col("is_translated").cast("long")).alias("translated"))


def filter_by_age(df: DataFrame, column: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows older than so many days; 0 or less keeps all."""
    if days <= 0:
        return df
    now = F.unix_timestamp() if now is None else now
    return df.where(F.col(column) < now - days * 86400)


def find_backups(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that are backups: stem_time.bak.ext, or ending in .bak."""
    return files.where(F.col(path).rlike(r"\.bak(?:\.[^./]+)?\z"))


def expired(files: DataFrame, ttl_days: int) -> DataFrame:
    return filter_by_age(find_backups(files), "mtime", ttl_days)


#: Parts after which an upsert writes the whole table anew, and versions that readers may still hold.
COMPACT, KEPT = 16, 3


class CacheTable:
    """A cache at a location; every change is one new version of the table."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.location).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        p = self._path(f"{self.location}/_versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.getPath().getName().endswith(".json")) if self._fs.exists(p) else []

    def _parts(self, name: str) -> list[str]:
        stream = self._fs.open(self._path(f"{self.location}/_versions/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def _head(self) -> tuple[int, list[str]]:
        """Number and parts of the last whole version."""
        for name in reversed(self._manifests()):
            try:
                return int(name[:-5]), self._parts(name)
            except ValueError:  # a writer died while it wrote the manifest
                continue
        return -1, []

    def exists(self) -> bool:
        return bool(self._head()[1])

    def read(self) -> DataFrame:
        """The newest entry of every key; an empty table where there is none yet."""
        return self._of(self._head()[1])

    def _of(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return latest(self.spark.read.schema(SCHEMA).parquet(*(f"{self.location}/{p}" for p in parts)))

    def _publish(self, df: DataFrame | None, head: tuple[int, list[str]], keep: list[str]) -> None:
        """df as a new part beside those that are kept."""
        parts = list(keep)
        if df is not None:
            parts.append(f"part-{uuid.uuid4().hex}")
            df.write.parquet(f"{self.location}/{parts[-1]}")
        last = max([head[0], *(int(n[:-5]) for n in self._manifests())])
        if last > head[0] and self._head()[0] != head[0]:
            raise RuntimeError("another writer has changed the cache")
        out = self._fs.create(self._path(f"{self.location}/_versions/{last + 1:012d}.json"), False)  # exclusive
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        self._sweep()

    def _sweep(self) -> None:
        """Versions that no reader should hold any more go, with the parts only they name."""
        names = self._manifests()
        old, kept = names[:-KEPT], names[-KEPT:]
        used: set[str] = set()
        for n in kept:
            try:
                used |= set(self._parts(n))
            except ValueError:
                pass
        for n in old:
            try:
                for p in set(self._parts(n)) - used:
                    self._fs.delete(self._path(f"{self.location}/{p}"), True)
            except ValueError:
                pass
            self._fs.delete(self._path(f"{self.location}/_versions/{n}"), False)

    def upsert(self, entries: DataFrame) -> None:
        """Newer entries of a key take the place of older ones, as soon as the table is read."""
        head = self._head()
        rows = latest(entries.select(*[c.split()[0] for c in SCHEMA.split(", ")]))
        if len(head[1]) < COMPACT:
            self._publish(rows, head, head[1])
        else:
            self._publish(latest(self._of(head[1]).unionByName(rows)), head, [])

    def invalidate(self, file_hash: str) -> None:
        """Also the last entry of a table is really removed. Only parts that hold the hash are written anew."""
        head = self._head()
        read = lambda p: self.spark.read.schema(SCHEMA).parquet(f"{self.location}/{p}")
        hit = [p for p in head[1] if not read(p).where(F.col("file_hash") == file_hash).isEmpty()]
        if hit:
            rest = None
            for p in hit:
                rest = read(p) if rest is None else rest.unionByName(read(p))
            self._publish(rest.where(F.col("file_hash") != file_hash), head, [p for p in head[1] if p not in hit])

    def clear(self) -> None:
        self._fs.delete(self._path(self.location), True)

    def cleanup(self, existing: DataFrame) -> int:
        head = self._head()
        now = self._of(head[1])
        gone = orphans(now, existing).count()
        if gone:
            self._publish(now.join(existing.select("file_hash").distinct(), "file_hash", "left_semi"), head, [])
        return gone

    def entries(self) -> DataFrame:
        return self.read().select("file_hash", "path")


def resolve_dir(mode: str, project: str, directory: str | None = None, home: str = "~") -> str:
    """Folder of a cache: the configured one, else inside the project (local) or the home."""
    if directory:
        return directory
    return f"{project.rstrip('/')}/.loomtext" if mode == "local" else f"{home.rstrip('/')}/.loomtext/cache"


def mark_translated(entries: DataFrame, at: Column) -> DataFrame:
    return entries.withColumn("is_translated", F.lit(True)).withColumn("translated_at", at)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
