"""python -m loomtext [command] PATH: verify, detect, translate (dry run or echo), clean, cache,
init, validate, status. Without a command: a dry run of translate on the current folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loomtext import events
from loomtext.operators.translate import EchoProvider, Service
from loomtext.plans import commands as C
from loomtext.sources import cache_table as B
from loomtext.sources import config as G


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    p.add_argument("command", nargs="?", default="translate", choices=["verify", "detect", "translate", "clean", "cache", "init", "validate", "status"])
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--language", default="CJK", help="script of detect")
    p.add_argument("--pattern"), p.add_argument("--ext"), p.add_argument("--category"), p.add_argument("--search")
    p.add_argument("--format", default="table", choices=["table", "json", "csv"])
    p.add_argument("--out", help="folder of the results")
    p.add_argument("--days", type=int, default=0)
    p.add_argument("--action", default="stats", choices=["stats", "list", "clear"])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--log-level", default="info")
    return p


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    events.init(a.log_level)
    if a.command == "init":
        print(C.init(a.path))
        return 0
    if a.command == "validate":
        problems = C.validate(a.path)
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    glob, cfg = G.load(a.path)
    if a.command == "status":
        print(json.dumps(C.status(glob), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("loomtext").getOrCreate()
    cache = B.CacheTable(spark, B.resolve_dir(cfg.cache_mode, a.path, cfg.cache_directory) + "/cache")
    if a.command == "verify":
        only = {k: v for k, v in (("pattern_name", a.pattern), ("ext", a.ext), ("category", a.category), ("text", a.search)) if v is not None}
        m, s = C.verify(spark, a.path, cfg, **only)
        if a.format == "table":
            C.match_table(m).show(100, False)
            s.orderBy("dimension", "value").show(200, False)
        else:
            C.format_matches(m, a.format, a.out or "matches")
    elif a.command == "detect":
        seg, tot = C.detect(spark, a.path, a.language, cfg)
        C.detect_report(seg).orderBy("path", "start_line").show(200, False)
        tot.show()
    elif a.command == "clean":
        C.clean(spark, a.path, a.days).show(200, False)
    elif a.command == "cache":
        got = C.cache_command(cache, a.action)
        if got is not None:
            got.show(100, False)
    else:
        counts = C.translate(spark, a.path, a.out or "translated", lambda options: Service([EchoProvider()], options=options), cfg, None, a.dry_run or not a.out)
        events.event("finished", **counts)
        print(C.report(counts))
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
