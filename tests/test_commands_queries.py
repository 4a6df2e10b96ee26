import inspect
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.operators import translate as T
from loomtext.plans import commands as C
from loomtext.plans import registry
from loomtext.sources import cache_table as B
from loomtext.sources import config as G

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "src"
    (d / "sub").mkdir(parents=True)
    (d / "a.py").write_text("# 你好\nx = '世界'\n")
    (d / "sub" / "b.js").write_text("// 早上好\r\nlet a = `好 ${x}`;\r\n", newline="")
    (d / "c.unknown").write_text("你好")
    (d / "e.py").write_text("# english only\n")
    return d


def test_verify(spark, tree, tmp_path):
    cfg = G.ProjectConfig(source_langs=["zh"], target_lang="en")
    m, s = C.verify(spark, str(tree), cfg)
    got = sorted((r["category"], r["extracted_text"]) for r in m.collect())
    assert got == [("other", "你好"), ("other", "早上好"), ("string", "世界")]
    tot = {(r["dimension"], r["value"]): (r["n"], r["total_files"]) for r in s.collect()}
    assert tot["total", None] == (3, 4) and tot["file_type", "py"][0] == 2 and tot["category", "string"][0] == 1
    m2, _ = C.verify(spark, str(tree), cfg, ext="JS")
    assert m2.count() == 1
    C.format_matches(m, "csv", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert C.match_table(m).count() == 3


def test_detect(spark, tree):
    seg, tot = C.detect(spark, str(tree))
    assert seg.count() == 3 and tot.first()["matching_lines"] == 5
    assert all("你好" in r["report"] or "好" in r["report"] for r in C.detect_report(seg).collect())
    with pytest.raises(ValueError):
        C.detect(spark, str(tree), "KLINGON")


def test_translate_with_cache(spark, tree, tmp_path):
    words = {"你好": "Hello", "世界": "World", "早上好": "Good morning"}
    make = lambda options: T.Service([T.DictionaryProvider(words)], options=options)
    cfg = G.ProjectConfig(source_langs=["zh"], include=["*.py", "*.js"])
    cache = B.CacheTable(spark, str(tmp_path / "cache"))
    out = tmp_path / "out"
    dry = C.translate(spark, str(tree), str(out), make, cfg, cache, dry_run=True)
    assert dry["units"] == 3 and not out.exists()
    one = C.translate(spark, str(tree), str(out), make, cfg, cache)
    assert (one["translated"], one["written"], one["cache_hits"]) == (3, 2, 0)
    assert (out / "a.py").read_text() == "# Hello\nx = 'World'\n"
    assert (out / "sub" / "b.js").read_bytes() == "// Good morning\r\nlet a = `好 ${x}`;\r\n".encode()
    two = C.translate(spark, str(tree), str(out), make, cfg, cache)
    assert two["cache_hits"] == 3 and two["processed"] == 0
    assert C.cache_command(cache, "stats").first()["entries"] == 5
    assert "Cache hit rate: 100.0%" in C.report(two) and json.loads(C.report(two, "json"))["cache_hits"] == 3


def test_settings_act(spark, tree, tmp_path):
    """Limits, batch size and concurrency reach the service; the filter is part of the configuration's hash; ignore patterns hold everywhere."""
    seen = []

    def make(options):
        seen.append(options)
        return T.Service([T.DictionaryProvider({})], options=options)

    cfg = G.ProjectConfig(source_langs=["zh"], batch_size=7, concurrency=2, max_char_count=90, split_max_chars=40)
    o = C.service_options(cfg, rate=10)
    assert (o.batch_size, o.split_above, o.split_size, o.rate) == (7, 90, 40, 5.0)
    s = T.Service([T.EchoProvider()], options=o)
    parts = []
    s._call = lambda name, texts, a, b: parts.extend(texts) or texts
    assert s.one("x" * 91, "zh", "en")[0] == "x" * 91 and max(map(len, parts)) == 40 and s.one("y" * 90, "zh", "en")[0] == "y" * 90 and parts[-1] == "y" * 90
    a, b = C.flat_settings(cfg), C.flat_settings(G.ProjectConfig(filter=G.FilterConfig(min_length=5)))
    assert any(k.startswith("filter.") for k in a) and {k for k in a if k.startswith("filter.") and a[k] != b[k]} == {"filter.min_length"}
    all_, few = (C.detect(spark, str(tree), cfg=G.ProjectConfig(gitignore_patterns=p))[1].first()["files"] for p in ([], ["sub/"]))
    assert few == all_ - 1
    none = C.translate(spark, str(tree), str(tmp_path / "o"), make, G.ProjectConfig(source_langs=["zh"], gitignore_patterns=["*"]), dry_run=True)
    assert none["total_files"] == 0


def test_state_machine_and_custom_units(spark, tree):
    cfg = G.ProjectConfig(source_langs=["zh"], custom_patterns=[{"name": "q", "regex": "'([^']*)'", "group": 1, "extensions": ["py"], "category": "string"}],
                          state_machines=[{"name": "m", "initial": "a", "accepting": ["a"], "states": [{"name": "a", "regex": "早上"}], "extensions": ["js"]}])
    m, _ = C.verify(spark, str(tree), cfg)
    assert {(r["pattern_type"], r["pattern_name"]) for r in m.collect()} >= {("CustomRegex", "q"), ("StateMachine", "m"), ("Builtin", "comment")}


def test_upkeep(spark, tmp_path):
    assert C.validate(C.init(str(tmp_path)).rsplit("/", 1)[0], env={}) == []
    (tmp_path / G.PROJECT_FILE).write_text("nonsense = 1\n")
    assert "nonsense" in C.validate(str(tmp_path), env={})[0]
    assert C.report_name("r_{timestamp}.{format}", "text", 0) == "r_19700101_000000.txt"
    assert C.save_report(str(tmp_path), "x.{format}", {"total_files": 0}, "json").endswith("x.json")
    assert C.status(G.GlobalConfig(providers=[G.Provider(id="a", api_key="secret", models=["m"])]))[0]["usable"]


def rows(values):
    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return v

    return sorted(tuple(repr(norm(x)) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        df.write.format("noop").mode("overwrite").save()
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    import os

    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    r = con.sql(sql)
    assert sorted(r.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    assert rows(df.select(*[F.col(f"`{c}`") for c in cols]).collect()) == rows(r.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_entry(spark):
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert all(len(inspect.signature(f).parameters) >= 2 for f in entry.queries().values())


def test_core_does_not_import_llm():
    import pathlib

    for p in pathlib.Path("loomtext").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomtext.llm" not in p.read_text()


def test_command_line(spark, tree, tmp_path, capsys):
    from loomtext import events
    from loomtext.__main__ import run

    assert run(["init", str(tree)], spark) == 0 and run(["validate", str(tree)], spark) == 0
    for argv in (["verify", str(tree)], ["detect", str(tree)], ["translate", str(tree), "--dry-run"], ["cache", str(tree)], ["clean", str(tree)], ["status", str(tree)], ["verify", str(tree), "--format", "json", "--out", str(tmp_path / "j")]):
        assert run(argv, spark) == 0
    assert "Units" in capsys.readouterr().out
    with pytest.raises(ValueError):
        events.init("loud")
    log = tmp_path / "x.log"
    events.init("info", "file", str(log))
    events.event("file", path="a", n=1)
    assert "file path='a' n=1" in log.read_text()
