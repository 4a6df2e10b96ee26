"""Scans of source trees and tables of files, with include, exclude and ignore rules."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import file_system


def glob_regex(glob: str) -> str | None:
    """Regular expression of a glob over a whole path: * and ? also match a slash, [...] is a
    class. None for a glob that isn't valid."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("***", i):
                return None
            out += ".*"
            i += 1 if glob[i : i + 2] != "**" else 2
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "]") else i + 1)
            if end < 0:
                return None
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("^", "\\^")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return r"(?s)\A" + out + r"\z"


def match_pattern(path: Column, glob: str) -> Column:
    """A glob with ** by prefix and suffix, any other over the whole path; an invalid one matches nothing."""
    if "**" in glob:
        return match_recursive(path, glob)
    p = glob_regex(glob)
    return path.rlike(p) if p else F.lit(False)


def match_recursive(path: Column, glob: str) -> Column:
    """prefix**suffix: the path starts with the prefix and ends with the suffix; a suffix with one
    star is matched by the start and end of the file name."""
    prefix, _, rest = glob.partition("**")
    suffix = rest.rpartition("**")[2].lstrip("/")
    ok = path.startswith(prefix) if prefix else F.lit(True)
    if not suffix:
        return ok
    name = F.element_at(F.split(path, "/"), -1)
    if suffix.count("*") == 1:
        a, b = suffix.split("*")
        return ok & name.startswith(a) & name.endswith(b)
    return ok & path.endswith(suffix)


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file."""

    pattern: str
    negated: bool = False
    anchored: bool = False
    dir_only: bool = False
    globstar: bool = False


def parse_ignore(line: str) -> IgnoreRule | None:
    """None for blank lines and comments."""
    s = line.strip()
    if not s or s.startswith("#"):
        return None
    negated = s.startswith("!")
    s = s[1:] if negated else s
    dir_only = s.endswith("/")
    s = s.rstrip("/") if dir_only else s
    anchored = s.startswith("/")
    s = s.lstrip("/") if anchored else s
    return IgnoreRule(s, negated, anchored, dir_only, "**" in s) if s else None


def parse_ignores(lines: list[str]) -> list[IgnoreRule]:
    return [r for r in map(parse_ignore, lines) if r]


def piece_regex(pattern: str) -> str:
    """Pieces between stars in their order, the first at the start; the last needn't be at the end."""
    return r"\A" + ".*".join(re.escape(p) for p in pattern.split("*"))


def rule_matches(path: Column, rule: IgnoreRule) -> Column:
    """Does a rule match a relative path, by its leading parts (anchored), any run of its parts,
    or by ** over the whole path?"""
    parts = F.split(path, "/")
    want = rule.pattern.split("/")
    if rule.globstar:
        if rule.pattern.startswith("**/*") and "*" not in rule.pattern[4:]:
            return path.endswith(rule.pattern[4:])
        pieces = [re.escape(p) for p in re.split(r"\*+/?", rule.pattern) if p]
        return path.rlike("(?s)" + ".*".join(pieces)) if pieces else F.lit(True)

    def at(i) -> Column:
        return reduce(lambda a, b: a & b, (F.get(parts, F.lit(k) + i).rlike(piece_regex(w)) for k, w in enumerate(want)))

    n = len(want)
    if rule.anchored:
        return (F.size(parts) >= n) & F.coalesce(at(F.lit(0)), F.lit(False))
    places = F.when(F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - n)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: F.coalesce(at(i), F.lit(False)))


def is_ignored(path: Column, rules: list[IgnoreRule], is_dir: bool = False) -> Column:
    """The last rule that matches decides; a negated one keeps the path. Rules for directories
    don't match files."""
    own = [r for r in rules if is_dir or not r.dir_only]
    return reduce(lambda rest, r: F.when(rule_matches(path, r), F.lit(not r.negated)).otherwise(rest), own, F.lit(False))


def parents(path: Column) -> Column:
    """Every directory a path lies in, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def include_file(path: Column, include: list[str] = (), exclude: list[str] = (), rules: list[IgnoreRule] = ()) -> Column:
    """Included (an empty list includes all), not excluded, not ignored, and in no directory that
    is excluded or ignored. False for a null path."""
    any_of = lambda globs, c: reduce(lambda a, g: a | match_pattern(c, g), globs, F.lit(False))
    ok = any_of(include, path) if include else F.lit(True)
    ok = ok & ~any_of(exclude, path) & ~is_ignored(path, list(rules))
    if exclude or rules:
        ok = ok & ~F.exists(parents(path), lambda d: exclude_dir(d, exclude, rules))
    return F.coalesce(ok, F.lit(False))


def exclude_dir(path: Column, exclude: list[str] = (), rules: list[IgnoreRule] = ()) -> Column:
    return reduce(lambda a, g: a | match_pattern(path, g), exclude, F.lit(False)) | is_ignored(path, list(rules), is_dir=True)


@dataclass
class ScanOptions:
    root: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    use_gitignore: bool = True
    gitignore_path: str | None = None
    gitignore_patterns: tuple[str, ...] = ()


def load_ignores(spark: SparkSession, opts: ScanOptions) -> list[IgnoreRule]:
    """Rules of the ignore file at the root (or the given path) and of the options: lines of one
    configuration file, read by the driver."""
    lines: list[str] = []
    if opts.use_gitignore:
        name = opts.gitignore_path or posixpath.join(opts.root, ".gitignore")
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):  # not by spark.read: it leaves out names that begin with a dot
            stream = fs.open(path)
            lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return parse_ignores([*lines, *opts.gitignore_patterns])


#: Directories whose rules are judged at once, and files whose contents are read by one relation.
LEVEL, FILES = 10_000, 200_000


def listed(spark: SparkSession, opts: ScanOptions) -> list[tuple[str, str]]:
    """[(path, relative path)] of the files that the rules take: names only, as any file index keeps them. A tree is
    listed level by level, and no directory is opened that is excluded or ignored or lies in one that is."""
    if not opts.root:
        raise ValueError("an empty root")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(opts.root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(opts.root)
    rules = load_ignores(spark, opts)
    status = fs.getFileStatus(hadoop)
    root = status.getPath().toString().rstrip("/")
    if status.isFile():
        return _kept(spark, [root.rpartition("/")[2]], lambda p: include_file(p, list(opts.include), list(opts.exclude), rules), root.rpartition("/")[0])
    files, level = [], [""]
    while level:
        below = []
        for rel in level:
            for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{rel}" if rel else root)):
                name = s.getPath().getName()
                (below if s.isDirectory() else files).append(f"{rel}/{name}" if rel else name)
        level = [r for _, r in _kept(spark, below, lambda p: ~exclude_dir(p, list(opts.exclude), rules), root)] if opts.exclude or rules else below
    # the directories are judged already, but a rule that brings a path back may ask for its parents again
    return _kept(spark, files, lambda p: include_file(p, list(opts.include), list(opts.exclude), rules), root)


def _kept(spark: SparkSession, names: list[str], rule, root: str) -> list[tuple[str, str]]:
    out = []
    for i in range(0, len(names), LEVEL):
        part = spark.createDataFrame([(x,) for x in names[i : i + LEVEL]], "p string")
        out += [(f"{root}/{r['p']}", r["p"]) for r in part.where(F.coalesce(rule(F.col("p")), F.lit(False))).collect()]
    return sorted(out)


def scan(spark: SparkSession, opts: ScanOptions) -> DataFrame:
    """(path, rel_path, ext, length, mtime, content) of one file or a tree. FileNotFoundError for
    a root that doesn't exist. The rules are applied to names; only the contents of the files they take are read."""
    found = listed(spark, opts)
    status = spark._jvm.org.apache.hadoop.fs.Path(opts.root)
    status = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status)
    root = status.getPath().toString().rstrip("/")
    root = root.rpartition("/")[0] if status.isFile() else root
    # Spark's file sources pass over names that begin with a dot or a low line, as __init__.py does
    plain = [p for p, _ in found if not p.rpartition("/")[2].startswith((".", "_"))]
    rest = [p for p, _ in found if p.rpartition("/")[2].startswith((".", "_"))]
    parts = []
    for i in range(0, len(plain), FILES):
        # globs are taken literally: their signs are escaped
        paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in plain[i : i + FILES]]
        parts.append(spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("mtime"), "content"))
    if rest or not parts:
        names = spark.createDataFrame([(p,) for p in rest], "path string").repartition(max(1, min(len(rest) // 100, 1000)))
        parts.append(names.mapInPandas(_contents, "path string, length long, mtime timestamp, content binary"))
    df = reduce(DataFrame.unionByName, parts)
    return df.select("path", F.substring("path", len(root) + 2, 1 << 30).alias("rel_path"), F.regexp_extract("path", r"\.([^./]+)\z", 1).alias("ext"), "length", "mtime", "content")


def _contents(batches):
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            store, name = file_system(path)
            with store.open_input_stream(name) as f:
                data = f.read()
            rows.append((path, len(data), pd.Timestamp(store.get_file_info(name).mtime).tz_convert(None), data))
        yield pd.DataFrame(rows, columns=["path", "length", "mtime", "content"])
