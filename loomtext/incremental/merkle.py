"""Incremental processing by a Merkle tree over key-range hashes.

A *state* is a set of leaves (key, digest). Keys fall into ranges of the 64-bit hash of
the key; a tree node is the digest of all leaves in its range, so a node of level L
covers the keys that share the first L*FAN_BITS bits. Two states are compared from the
root down: a node is opened only where the digests differ, and only the leaves of the
differing bottom ranges take part in the join that extracts the changed keys.

Everything is DataFrame work. The node digests are made by one partial aggregation of
the leaves. The depth of the tree follows from the number of leaves, so that a bottom range holds
about LEAVES_PER_NODE of them: more keys give more ranges, not fuller ones. Nodes are compared level by
level by joins of the opened nodes only; nothing of the tree is collected.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import cut, table

FAN_BITS = 4
#: Leaves of a bottom range, about, and the least and greatest number of levels.
LEAVES_PER_NODE = 256
LEVELS, MOST_LEVELS = 1, 7
#: Nodes up to which the differing ones are broadcast.
FEW = 100_000


def clean_path(c: Column) -> Column:
    """One spelling of a path: slashes forward, no '.', empty or 'x/..' parts, no blanks around. Parts are folded
    from left to right, so '..' at any depth takes away the part before it; above the start it stays, below a
    root it falls away. Null stays null."""
    p = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    root = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        top = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        return (
            F.when(part != "..", F.array_append(done, part))
            .when(top != "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(root, done)
            .otherwise(F.array_append(done, part))
        )

    plain = ~p.rlike(r"(?:^|/)\.{1,2}(?:/|$)")  # nearly all: no array is made
    folded = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(plain, F.regexp_replace(p, r"(?<=.)/$", "")).otherwise(F.concat(F.when(root, "/").otherwise(""), folded))


def clean_hash(c: Column) -> Column:
    """One spelling of a SHA-256: lower-case hex, without prefix, separators or blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(?:sha-?256|0x)[:=\-]?", ""), r"[^0-9a-f]", "")


def levels_for(n: int) -> int:
    """Levels of a tree over n leaves."""
    need = max(0, (max(1, n) // LEAVES_PER_NODE).bit_length())
    return min(MOST_LEVELS, max(LEVELS, -(-need // FAN_BITS)))


def leaves(df: DataFrame, key: str, digest: str, levels: int) -> DataFrame:
    """(key, digest, node): node is the bottom range of the key. Null keys are dropped;
    a null digest is a leaf like any other (it differs from every digest)."""
    h = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - FAN_BITS * levels)
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.coalesce(F.col(digest), F.lit("")).alias("digest"), h.cast("int").alias("node")
    )


def bottom(leaf: DataFrame) -> DataFrame:
    """Digest of each bottom range: commutative, so it is combined before the shuffle."""
    h = F.xxhash64("key", "digest")
    return leaf.groupBy("node").agg(
        F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"), F.count("*").alias("n")
    )


def tree(nodes: DataFrame, levels: int) -> DataFrame:
    """All levels (level, node, x, s, n) above and including the bottom level: at most 16/15 of its rows. Every
    node of the bottom gives a row per level, combined before the shuffle."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    each = nodes.select("x", "s", "n", "node", up.alias("level"))
    node = F.expr(f"shiftright(node, {FAN_BITS} * ({levels} - level))")
    return each.groupBy("level", node.alias("node")).agg(F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.sum("n").alias("n"))


def differing(old: DataFrame, new: DataFrame, levels: int) -> DataFrame:
    """(node): bottom ranges whose digests differ between two trees. They are descended level by level from the root:
    only children of differing nodes are compared."""
    open_ = None
    for level in range(levels + 1):
        a, b = (t.where(F.col("level") == level).select("node", F.struct("x", "s", "n").alias(name)) for t, name in ((old, "a"), (new, "b")))
        if open_ is not None:
            parents = F.shiftright("node", FAN_BITS)
            a, b = (t.withColumn("__p", parents).join(open_.withColumnRenamed("node", "__p"), "__p", "left_semi").drop("__p") for t in (a, b))
        open_ = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return open_


def changes(old: DataFrame, new: DataFrame, levels: int, old_tree: DataFrame | None = None, new_tree: DataFrame | None = None, old_leaves=None) -> DataFrame:
    """Keys that differ between two states of leaves(): (key, change) with change one of
    added, changed, removed. Each key must occur once per state. Trees that are given are not made again.
    old_leaves(nodes) may read the old leaves of some bottom ranges only."""
    was, now = (cut(tree(bottom(leaf), levels)) if made is None else made for leaf, made in ((old, old_tree), (new, new_tree)))
    nodes = cut(differing(was, now, levels))
    some = F.broadcast(nodes) if nodes.count() <= FEW else nodes
    new = new.join(some, "node", "left_semi")
    old = old_leaves(nodes) if old_leaves else old.join(some, "node", "left_semi")
    o = old.select("key", F.col("digest").alias("was"))
    n = new.select("key", F.col("digest").alias("now"))
    return (
        o.join(n, "key", "full_outer")
        .where(~F.col("was").eqNullSafe(F.col("now")))
        .select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
    )


# -- states of the tables -------------------------------------------------------------


def scanned(files: DataFrame) -> DataFrame:
    """Current state: path, SHA-256 of the content of the newest scan.

    The hash is taken before the shuffle, so contents are never moved. Ties of scanned_at
    take the greater digest; a null scan time counts as the oldest; null paths are dropped;
    a null content has the digest of no bytes.
    """
    h = F.sha2(F.coalesce("content", F.lit(b"")), 256)
    return (
        files.where(F.col("path").isNotNull())
        .select("path", F.coalesce("scanned_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), h.alias("digest"))
        .groupBy("path")
        .agg(F.max_by("digest", F.struct("at", "digest")).alias("digest"))
        .select("path", clean_path(F.col("path")).alias("key"), "digest")
    )


def recorded(cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Last successful state: cleaned path, hash of the newest entry that is translated and
    belongs to a run with status success. Ties of created_at: the greater hash. Entries
    without path, hash or known run don't count."""
    good = runs.where(F.lower(F.trim("status")) == "success").select("run_id").distinct()
    return (
        cache.where(F.col("is_translated") & F.col("path").isNotNull() & F.col("file_hash").isNotNull())
        .join(F.broadcast(good) if _few(runs) else good, "run_id", "left_semi")
        .select(clean_path(F.col("path")).alias("key"), clean_hash(F.col("file_hash")).alias("digest"), "created_at")
        .groupBy("key")
        .agg(F.max_by("digest", F.struct("created_at", "digest")).alias("digest"))
    )


def _few(runs: DataFrame, rows: int = 100_000) -> bool:
    """The run table is broadcast only if it is counted to be small."""
    return runs.limit(rows + 1).count() <= rows


def pending(files: DataFrame, cache: DataFrame, runs: DataFrame) -> DataFrame:
    """(path): scanned paths that are new or changed against the last successful state."""
    # both states are made once and used by the tree and by the extraction of leaves
    now = cut(scanned(files))
    was = cut(recorded(cache, runs))
    levels = levels_for(now.count())
    one = now.groupBy("key").agg(F.max("digest").alias("digest"))  # of several spellings of a path the greatest digest
    changed = changes(leaves(was, "key", "digest", levels), leaves(one, "key", "digest", levels), levels)
    return now.join(changed.where(F.col("change") != "removed").select("key"), "key", "left_semi").select("path")


# -- runs that survive failures ---------------------------------------------------------


class Ledger:
    """Published states in a folder: <root>/<version>/{tree,leaves,output} and a manifest.

    A run takes the state once and writes its leaves, partitioned by groups of bottom ranges; everything else is
    made from these files, so a source that changes meanwhile is seen by the next run. It compares its tree with the
    saved tree of the parent version, reads only the parent's leaves of the ranges that differ, writes the output,
    and publishes leaves, tree and output at once by creating <root>/_manifest/<number>.json, exclusively: of two
    runs from one parent the first publishes, the other raises Conflict and is to be run again. A run that dies
    before that leaves a folder no manifest names, and the next run does the same work again. So nothing is
    skipped, and nothing that was published is repeated.
    """

    GROUPS = 1024

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        p = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self) -> dict | None:
        """The manifest of the last published version."""
        names = self._manifests()
        return self._read(names[-1]) if names else None

    def current(self) -> str | None:
        head = self.head()
        return head["version"] if head else None

    def leaves(self) -> DataFrame:
        v = self.current()
        if v is None:
            return self.spark.createDataFrame([], "key string, digest string, node int")
        return self.spark.read.parquet(f"{self.root}/{v}/leaves").select("key", "digest", "node")

    def output(self) -> DataFrame | None:
        """The outputs of all published versions."""
        names = [self._read(n)["version"] for n in self._manifests()]
        return self.spark.read.parquet(*(f"{self.root}/{v}/output" for v in names)) if names else None

    def run(self, state: DataFrame, process, fail_before_publish: bool = False) -> str | None:
        """state: (key, digest), one row per key. process(changed keys DataFrame) -> output
        DataFrame. Returns the published version, or None if nothing changed."""
        head = self.head()
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/{version}"
        try:
            state = cut(state.select("key", "digest"))
            levels = levels_for(state.count())
            if head and abs(levels - head["levels"]) <= 1:
                levels = head["levels"]  # a tree of nearly the right depth is kept, so that it can be compared
            new = leaves(state, "key", "digest", levels)
            shift = max(0, FAN_BITS * levels - (self.GROUPS.bit_length() - 1))
            new.withColumn("part", F.shiftright("node", shift)).repartition("part").write.partitionBy("part").parquet(f"{base}/leaves")
            new = self.spark.read.schema("key string, digest string, node int, part int").parquet(f"{base}/leaves")
            tree(bottom(new), levels).coalesce(1 + (1 << FAN_BITS * levels) // 1_000_000).write.parquet(f"{base}/tree")
            mine = self.spark.read.parquet(f"{base}/tree")
            diff = cut(self._changes(head, new, mine, levels, shift))
            if diff.isEmpty():
                self._fs.delete(self._path(base), True)
                return None
            process(diff.where(F.col("change") != "removed").select("key")).write.parquet(f"{base}/output")
            if fail_before_publish:
                raise RuntimeError("stopped before publishing")
            self._publish(version, head, levels)
        except Conflict:
            self._fs.delete(self._path(base), True)
            raise
        return version

    def _changes(self, head: dict | None, new: DataFrame, mine: DataFrame, levels: int, shift: int) -> DataFrame:
        if head is None:
            return new.select("key", F.lit("added").alias("change"))
        saved = self.spark.read.schema("key string, digest string, node int, part int").parquet(f"{self.root}/{head['version']}/leaves")
        if head["levels"] != levels:  # the table has grown or shrunk a lot: the saved leaves are put into new ranges
            return changes(leaves(saved, "key", "digest", levels), new, levels, new_tree=mine)

        def of(nodes: DataFrame) -> DataFrame:
            parts = [r[0] for r in nodes.select(F.shiftright("node", shift)).distinct().collect()]  # at most GROUPS numbers
            some = F.broadcast(nodes) if nodes.count() <= FEW else nodes
            return saved.where(F.col("part").isin(parts)).join(some, "node", "left_semi")

        return changes(saved, new, levels, old_tree=self.spark.read.parquet(f"{self.root}/{head['version']}/tree"), new_tree=mine, old_leaves=of)

    def _publish(self, version: str, head: dict | None, levels: int) -> None:
        number = head["number"] + 1 if head else 0
        folder = f"{self.root}/_manifest"
        self._fs.mkdirs(self._path(folder))
        body = {"number": number, "version": version, "parent": head["version"] if head else None, "levels": levels, "at": time.time()}
        tmp, final = self._path(f"{folder}/.{version}.tmp"), self._path(f"{folder}/{number:012d}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        lock = self._path(f"{folder}/.{number:012d}.lock")
        try:
            self._fs.create(lock, False).close()  # exclusive: one run only may follow a parent
        except Exception as x:
            if self._fs.exists(lock) and not self._fs.exists(final):
                # the run that held it died between the two steps, or is about to publish
                raise Conflict(f"another run publishes number {number}; remove {lock.toString()} if it died") from x
            raise Conflict(f"number {number} is published already") from x
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            raise Conflict(f"number {number} could not be published")


class Conflict(RuntimeError):
    """Another run has published after the same parent."""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): paths of source_files to process again."""
    return pending(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "cache_entries"), table(spark, sf_dir, "scan_runs"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, n_matches): the pending paths with the number of distinct matches to redo."""
    m = table(spark, sf_dir, "verify_matches").where(F.col("path").isNotNull())
    per = m.select("path", "match_id").distinct().groupBy("path").agg(F.count("match_id").alias("n_matches"))
    return p5_found(spark, sf_dir).join(per, "path", "left").select("path", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


_FOLD = r"""list_reduce(list_prepend('', list_filter(string_split(regexp_replace(trim({0}), '[\\/]+', '/', 'g'), '/'), lambda x: x NOT IN ('', '.'))),
    lambda a, x: CASE WHEN x <> '..' THEN a || '/' || x WHEN a = '' AND starts_with(trim({0}), '/') THEN a WHEN a = '' OR ends_with(a, '/..') THEN a || '/..' ELSE regexp_replace(a, '/[^/]*$', '') END)"""


def _fold_sql(column: str) -> str:
    e = _FOLD.format(column)
    return f"CASE WHEN starts_with(regexp_replace(trim({column}), '[\\\\/]+', '/', 'g'), '/') THEN '/' || ltrim({e}, '/') ELSE ltrim({e}, '/') END"


_P5 = f"""
WITH now AS (
  SELECT path, arg_max(sha256(content), scanned_at) AS digest FROM source_files GROUP BY path),
was AS (
  SELECT {_fold_sql('path')} AS path,
         arg_max(replace(lower(trim(file_hash)), 'sha256:', ''), created_at) AS digest
  FROM cache_entries
  WHERE is_translated AND run_id IN (SELECT run_id FROM scan_runs WHERE status = 'success')
  GROUP BY 1),
todo AS (SELECT n.path AS path FROM now n LEFT JOIN was w ON {_fold_sql('n.path')} = w.path
  WHERE w.digest IS NULL OR w.digest <> n.digest)
"""
P5_SQL = _P5 + "SELECT path FROM todo"
P5_MATCHES_SQL = _P5 + """, m AS (SELECT path, count(DISTINCT match_id) AS n_matches FROM verify_matches WHERE path IS NOT NULL GROUP BY 1)
SELECT t.path AS path, coalesce(n_matches, 0) AS n_matches FROM todo t LEFT JOIN m USING (path)"""
