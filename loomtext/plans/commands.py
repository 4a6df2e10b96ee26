"""The commands as functions from a source tree to DataFrames: verify, detect, translate, and the
upkeep of caches and configurations. Errors of one file are a column, never the end of a job."""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Callable
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import encoding as E
from loomtext.functions import scalars as C
from loomtext.functions import scripts as S
from loomtext.operators import clean as K
from loomtext.operators import filters as P
from loomtext.operators import lexer as X
from loomtext.operators import machines as Q
from loomtext.operators import translate as T
from loomtext.operators import windows as O
from loomtext.operators import writer as W
from loomtext.session import cut, spread
from loomtext.sources import cache_table as B
from loomtext.sources import config as G
from loomtext.sources import scan as N


def scan_options(root: str, cfg: G.ProjectConfig) -> N.ScanOptions:
    return N.ScanOptions(root, tuple(cfg.include), tuple(cfg.exclude), cfg.use_gitignore, None, tuple(cfg.gitignore_patterns))


def flat_settings(cfg, prefix: str = "") -> dict:
    """All settings by their names, nested ones with dots; lists of tables as JSON."""
    out = {}
    for f in fields(cfg):
        v = getattr(cfg, f.name)
        if is_dataclass(v):
            out |= flat_settings(v, f"{prefix}{f.name}.")
        elif isinstance(v, (list, tuple)) and any(isinstance(x, dict) for x in v):
            out[prefix + f.name] = json.dumps(v, sort_keys=True)
        else:
            out[prefix + f.name] = list(v) if isinstance(v, (tuple, set, frozenset)) else v
    return out


def service_options(cfg: G.ProjectConfig, rate: float = 0.0) -> T.Options:
    """Options of a service from a project's settings: texts above max_char_count are split into parts of at most
    split_max_chars. The rate is that of the whole job; each of its concurrent tasks gets its share."""
    return T.Options(batch_size=cfg.batch_size, split_above=cfg.max_char_count, split_size=cfg.split_max_chars, rate=rate / max(1, cfg.concurrency) if rate else 0.0)


def read_texts(files: DataFrame, least: float = 0.7) -> DataFrame:
    """files(path, ext, content) with encoding, text (without mark) and error."""
    d = files.withColumn("__d", E.detect(F.col("content")))
    low = F.col("__d.confidence") < least
    text = F.when(~low, E.to_text(F.col("content"), F.col("__d.encoding")))
    return d.select(*files.columns, F.col("__d.encoding").alias("encoding"), text.alias("text"), F.when(low, "encoding confidence too low").when(~X.can_parse(F.col("ext")), "no rule for this file type").alias("error"))


def units_of(files: DataFrame, cfg: G.ProjectConfig) -> DataFrame:
    """All units of files(path, ext, text): the lexer's, those of custom patterns, and those of
    state machines; of equal ones the first. In the order of their places (path, start.offset)."""
    flt, src, target = cfg.filter, cfg.source_langs, cfg.target_lang
    cols = ["path", "idx", "node_type", "content", "raw_match", "start", "start_offset", "end_offset", "pattern_type", "pattern_name"]
    u = X.units(files.select("path", "ext", "text"), flt, src, target, cfg.min_bytes, cfg.max_bytes)
    kinds = F.col("kind")
    u = u.where(X.wanted(kinds, cfg.comments, cfg.doc_strings, cfg.string_literals))
    u = u.withColumn("start_offset", F.col("start.offset")).withColumn("end_offset", F.col("end.offset"))
    branches = [u.select(*cols)]
    if cfg.custom_patterns:
        c = X.custom_matches(files.select("path", "ext", "text"), cfg.custom_patterns)
        c = c.withColumn("node_type", F.when(F.col("category") == "string", "string_literal").otherwise("comment")).withColumn("start_offset", F.col("start.offset"))
        c = c.withColumn("end_offset", F.col("start_offset") + F.octet_length("content")).where(P.composite(F.col("content"), flt, src, target))
        branches.append(c.select(*cols))
    for m in cfg.state_machines:
        b = Q.Machine(m["name"], m["initial"], m["accepting"], [Q.State(s["name"], s["regex"], s.get("group"), s.get("final", False), [(t["target"], t.get("condition")) for t in s.get("transitions", [])]) for s in m["states"]], m.get("rule"))
        s = Q.machine_matches(files.select("path", "ext", "text"), b, exts=m.get("extensions"))
        s = s.join(files.select("path", "text"), "path")
        pre = F.left("text", F.col("begin"))
        s = s.withColumn("start", F.struct(C.line_of(pre).cast("int").alias("line"), C.column_of(pre).cast("int").alias("column"), F.octet_length(pre).cast("int").alias("offset")))
        s = s.withColumn("start_offset", F.col("start.offset")).withColumn("end_offset", F.col("start_offset") + F.octet_length("content")).withColumn("node_type", F.lit("string_literal")).withColumn("pattern_type", F.lit("StateMachine"))
        branches.append(s.where(P.composite(F.col("content"), flt, src, target)).select(*cols))
    return X.merged_units(*branches)


def verify(spark: SparkSession, root: str, cfg: G.ProjectConfig | None = None, **only) -> tuple[DataFrame, DataFrame]:
    """(matches, summary) of a tree. only: pattern_name, ext, category, text. The summary has one
    row per group (dimension, value, n) and the total; total_files counts the scanned files."""
    cfg = cfg or G.ProjectConfig()
    files = N.scan(spark, scan_options(root, cfg))
    texts = read_texts(files, cfg.min_confidence)
    m = P.match_filter(X.verify_matches(units_of(texts.where("error IS NULL"), cfg)), **only)
    return m, summary(m, files.count())


def summary(matches: DataFrame, total_files: int) -> DataFrame:
    m = matches.withColumn("file_type", C.extension(F.col("path")))
    names = ["pattern_name", "category", "file_type", "pattern_type"]
    g = m.groupingSets([[F.col(n)] for n in names] + [[]], *map(F.col, names)).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    mask = {n: 15 ^ (1 << (3 - i)) for i, n in enumerate(names)}
    dim = F.when(F.col("g") == 15, "total")
    for n, k in mask.items():
        dim = dim.when(F.col("g") == k, n)
    return g.select(dim.alias("dimension"), F.coalesce(*names).alias("value"), "n", F.lit(total_files).cast("long").alias("total_files"))


def format_matches(matches: DataFrame, kind: str, out: str) -> None:
    """Matches as json or csv files, the nested position as columns in csv."""
    if kind == "json":
        matches.write.mode("overwrite").json(out)
    elif kind == "csv":
        flat = matches.select("path", "pattern_name", "pattern_type", "category", F.col("position.line").alias("line"), F.col("position.column").alias("column"), "extracted_text", "raw_match")
        flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(out)
    else:
        raise ValueError(f"unknown format {kind!r}")


def match_table(matches: DataFrame, width: int = 50) -> DataFrame:
    """Rows for showing: file name, line, names, and the text shortened."""
    return matches.select(C.base_name(F.col("path")).alias("file"), F.col("position.line").alias("line"), "pattern_name", "category", C.shorten(F.regexp_replace("extracted_text", r"\s+", " "), width).alias("text")).orderBy("file", "line")


def detect(spark: SparkSession, root: str, script: str = "CJK", cfg: G.ProjectConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, totals): runs of lines that hold a script, and counts of files, lines and hits."""
    cfg = cfg or G.ProjectConfig()
    if script.upper() not in S.DETECT:
        raise ValueError(f"unknown script {script!r}")
    files = N.scan(spark, scan_options(root, cfg))
    lines = read_texts(files, 0.0).where("text IS NOT NULL").select("path", F.posexplode(K.lines(F.col("text"))).alias("i", "line_text")).withColumn("line", F.col("i") + 1)
    hit = S.matches_script(F.col("line_text"), script)
    seg = O.islands(lines.where(hit), ["path"], "line", "line_text")
    tot = lines.agg(F.countDistinct("path").alias("files"), F.count("*").alias("lines"), F.sum(hit.cast("long")).alias("matching_lines"))
    return seg, tot


def detect_report(segments: DataFrame) -> DataFrame:
    """One text per segment: its range, the first three lines, and how many more there are."""
    more = F.col("n_lines") - 3
    head = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    body = F.array_join(F.transform(F.slice("texts", 1, 3), lambda x: C.cut_with_dots(x, 100)), "\n")
    return segments.select("path", "start_line", F.concat_ws("\n", head, body, F.when(more > 0, F.concat(F.lit("... "), more.cast("string"), F.lit(" more lines")))).alias("report"))


def translate(spark: SparkSession, root: str, out: str, make: Callable[[T.Options], T.Service], cfg: G.ProjectConfig | None = None, cache: B.CacheTable | None = None, dry_run: bool = False, rate: float = 0.0) -> dict:
    """Translate a tree into another place. Files whose content, project and configuration the
    cache knows as translated are skipped; after the write the new contents are recorded too, so
    the next run hits. Returns the run's counters. make gets the project's options; at most concurrency tasks
    call providers at once, and rate is the calls a second of the whole job. dry_run neither calls providers nor writes."""
    cfg = (cfg or G.ProjectConfig()).normalized()
    began = time.time()
    source = next(iter(cfg.source_langs), "auto")
    print_ = C.project_id(F.lit(root))
    hashed = C.config_hash(flat_settings(cfg))
    files = N.scan(spark, scan_options(root, cfg))
    files = files.withColumn("file_hash", F.sha2("content", 256)).withColumn("project_fingerprint", print_).withColumn("config_hash", hashed)
    todo = files
    if cache:
        done = cache.read().where("is_translated").select(*B.KEY).distinct()
        todo = files.join(done, B.KEY, "left_anti")
    texts = cut(spread(read_texts(todo, cfg.min_confidence)))
    good = texts.where("error IS NULL")
    units = cut(units_of(good, cfg).withColumn("source_lang", F.lit(source)).withColumn("target_lang", F.lit(cfg.target_lang)))
    counts = {"total_files": files.count(), "processed": texts.count(), "units": units.count(), "errors": texts.where("error IS NOT NULL").count()}
    counts["cache_hits"] = counts["total_files"] - counts["processed"]
    if dry_run:
        return counts | {"translated": 0, "written": 0, "seconds": time.time() - began}
    options = service_options(cfg, rate)
    done = cut(T.translate(units.coalesce(cfg.concurrency), lambda: make(options)))
    fixed = done.where("error IS NULL").select("path", "content", "translated", "raw_match", F.col("start.line").alias("line"), F.col("start.column").alias("column"))
    rel = good.select(F.col("path").alias("full"), F.col("rel_path").alias("path"), "text", "file_hash", "mtime")
    applied = cut(W.apply_units(rel.select("full", "text").withColumnRenamed("full", "path"), fixed))
    applied = applied.join(rel.select(F.col("full").alias("path"), F.col("path").alias("rel")), "path").withColumn("path", F.col("rel")).drop("rel")
    written = cut(W.write_files(applied, out))
    if cache:
        now = F.lit(int(time.time()))
        bad = written.where("NOT success").select("path")
        rows = applied.join(bad, "path", "left_anti").join(rel, "path").withColumn("after_hash", F.sha2(F.encode("after", "UTF-8"), 256))
        entries = rows.select(F.explode(F.array_distinct(F.array("file_hash", "after_hash"))).alias("file_hash"), "path", F.unix_seconds("mtime").alias("last_modified"), F.lit(True).alias("is_translated"), now.cast("long").alias("translated_at"), now.cast("long").alias("created_at"), F.lit(cfg.cache_mode).alias("cache_mode"), print_.alias("project_fingerprint"), hashed.alias("config_hash"))
        cache.upsert(cut(entries))
    s = written.agg(F.sum("units_written").alias("w"), F.sum((~F.col("success")).cast("int")).alias("f")).first()
    return counts | {"translated": done.where("error IS NULL AND translated <> content").count(), "failed": done.where("error IS NOT NULL").count(), "written": s["w"] or 0, "write_errors": s["f"] or 0, "seconds": time.time() - began}


def report(counts: dict, kind: str = "text") -> str:
    """A run's counters as text or JSON."""
    if kind == "json":
        return json.dumps(counts, sort_keys=True)
    total, done = counts.get("total_files", 0), counts.get("processed", 0)
    speed = done / counts["seconds"] if counts.get("seconds") else 0.0
    lines = [f"{k.replace('_', ' ').capitalize()}: {v:.3f}" if isinstance(v, float) else f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in counts.items()]
    hit = 100.0 * counts.get("cache_hits", 0) / total if total else 0.0
    return "\n".join([*lines, f"Cache hit rate: {hit:.1f}%", f"Speed: {speed:.1f} files/s"])


def report_name(template: str, kind: str, now: float | None = None) -> str:
    """{timestamp} in UTC and {format} replaced."""
    stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime(now))
    return template.replace("{timestamp}", stamp).replace("{format}", {"text": "txt"}.get(kind, kind))


def save_report(folder: str, template: str, counts: dict, kind: str = "text") -> str:
    path = posixpath.join(folder, report_name(template, kind))
    with open(path, "w") as f:
        f.write(report(counts, kind))
    return path


def cache_command(cache: B.CacheTable, action: str, existing: DataFrame | None = None):
    """stats, list, clear or cleanup."""
    if action == "stats":
        return B.stats(cache.read())
    if action == "list":
        return cache.entries()
    if action == "clear":
        return cache.clear()
    if action == "cleanup":
        return cache.cleanup(existing)
    raise ValueError(f"unknown action {action!r}")


def clean(spark: SparkSession, root: str, days: int = 0) -> DataFrame:
    """Backup files below a root, older than so many days."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.unix_seconds("modificationTime").alias("mtime"))
    return B.filter_by_age(B.find_backups(files), "mtime", days)


def init(folder: str) -> str:
    """A project file with the defaults; an existing one is kept."""
    path = posixpath.join(folder, G.PROJECT_FILE)
    if not posixpath.exists(path):
        G.save(G.ProjectConfig(), path)
    return path


def validate(folder: str, env: dict[str, str] | None = None) -> list[str]:
    """Problems of the configuration of a folder; none if it can be used."""
    try:
        G.load(folder, env=env)
    except (G.ConfigError, ValueError) as x:
        return [str(x)]
    return []


def status(cfg: G.GlobalConfig) -> list[dict]:
    """Providers and whether they could be used; keys are never shown."""
    return [{"id": p.id, "kind": p.kind, "models": p.models, "enabled": p.enabled, "usable": G.usable(p)} for p in cfg.providers]
