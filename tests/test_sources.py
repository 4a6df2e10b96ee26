import os

import pytest
from pyspark.sql import functions as F

from loomtext.functions import encoding as E
from loomtext.sources import cache_table as B
from loomtext.sources import config as G
from loomtext.sources import scan as N


def ignored(spark, paths, lines):
    rules = N.parse_ignores(lines)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    return [r[1] for r in df.select("i", N.is_ignored(F.col("p"), rules)).orderBy("i").collect()]


def test_ignore_rules(spark):
    assert ignored(spark, ["important.log", "test.log", "a.log.txt", "b.txt"], ["*.log", "!important.log"]) == [False, True, True, False]
    assert ignored(spark, ["target", "src/target"], ["/target"]) == [True, False]
    assert ignored(spark, ["x"], ["a/b/c"]) == [False]  # more parts than the path
    assert N.parse_ignore("# c") is None and N.parse_ignore(" ") is None
    assert N.parse_ignore("!/a/") == N.IgnoreRule("a", True, True, True, False)


def test_scan(spark, tmp_path):
    for name, text in {"a.py": "x", "sub dir/b-1.py": "y", "sub dir/c.log": "z", "out/d.py": "w", ".gitignore": "*.log\n/out/\n", "pkg/__init__.py": "v"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    rel = lambda **kw: sorted(r["rel_path"] for r in N.scan(spark, N.ScanOptions(str(tmp_path), **kw)).select("rel_path").collect())
    assert rel(include=("*.py",)) == ["a.py", "pkg/__init__.py", "sub dir/b-1.py"]
    assert rel(include=("*.py",), use_gitignore=False) == ["a.py", "out/d.py", "pkg/__init__.py", "sub dir/b-1.py"]
    assert rel(include=("**/*.py",), exclude=("sub*",)) == ["a.py", "pkg/__init__.py"]
    one = N.scan(spark, N.ScanOptions(str(tmp_path / "a.py"))).first()
    assert (one["rel_path"], one["ext"], bytes(one["content"])) == ("a.py", "py", b"x")
    init = N.scan(spark, N.ScanOptions(str(tmp_path / "pkg"))).first()
    assert (init["rel_path"], init["length"], bytes(init["content"])) == ("__init__.py", 1, b"v")
    with pytest.raises(FileNotFoundError):
        N.scan(spark, N.ScanOptions(str(tmp_path / "none")))
    (tmp_path / "empty").mkdir()
    assert N.scan(spark, N.ScanOptions(str(tmp_path / "empty"))).count() == 0


def test_excluded_folders_are_never_opened(spark, tmp_path):
    for name in ("src/a.py", "vendor/deep/b.py", "build/c.py", "odd[1]{x}.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    opened = []

    real = N._kept
    try:
        N._kept = lambda spark, names, rule, root: (opened.append(list(names)), real(spark, names, rule, root))[1]
        got = N.listed(spark, N.ScanOptions(str(tmp_path), exclude=("vendor*",), gitignore_patterns=("build/",)))
    finally:
        N._kept = real
    assert [r for _, r in got] == ["odd[1]{x}.py", "src/a.py"] and all("deep" not in x for names in opened for x in names)
    assert N.scan(spark, N.ScanOptions(str(tmp_path), exclude=("vendor*",), gitignore_patterns=("build/",))).count() == 2


def test_globs(spark):
    assert N.glob_regex("[") is None and N.glob_regex("***") is None
    df = spark.createDataFrame([("src/a.rs",), ("lib/x_test.rs",)], "p string")
    assert [r[0] for r in df.select(N.match_pattern(F.col("p"), "src/**")).collect()] == [True, False]
    assert [r[0] for r in df.select(N.match_pattern(F.col("p"), "**/*_test.rs")).collect()] == [False, True]
    assert [r[0] for r in df.select(N.match_pattern(F.col("p"), "[")).collect()] == [False, False]


def test_encodings(spark):
    rows = [(b"",), (b"abc",), ("Hello 世界".encode(),), (b"\xef\xbb\xbfx",), (b"\xff\xfea\0",), ("你好".encode("gbk"),), (None,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c binary")
    got = [(r[1], r[2]) for r in df.select("i", E.detect(F.col("c"))["encoding"], E.detect(F.col("c"))["confidence"]).orderBy("i").collect()]
    assert got[:5] == [("UTF-8", 1.0), ("UTF-8", 1.0), ("UTF-8", 0.9), ("UTF-8", 1.0), ("UTF-16LE", 1.0)]
    assert got[5][1] >= 0.5 and got[6] == (None, None)
    texts = [r[1] for r in df.select("i", E.to_text(F.col("c"), E.detect(F.col("c"))["encoding"])).orderBy("i").collect()]
    assert texts == ["", "abc", "Hello 世界", "x", "a", "你好", None]
    for name, b in (("GBK", "C4E3BAC3"), ("Big5", "A440A455"), ("Shift_JIS", "82A082A2")):
        assert E.double_byte_score(bytes.fromhex(b), name) >= 0.5
    assert E.guess(bytes([0xFF])) == ("UTF-8", 0.3)


def test_low_confidence_raises(spark):
    df = spark.createDataFrame([(bytes([0x80, 0x81, 0x82, 0x83]),)], "c binary")
    with pytest.raises(Exception, match="confidence"):
        df.select(E.confident(F.col("c"), 1.01)).collect()


def test_encode_round_trip(spark):
    df = spark.createDataFrame([("你好 abc", n) for n in ("GBK", "Big5", "Shift_JIS", "UTF-16LE", "UTF-8")], "t string, e string")
    back = df.select("t", E.to_text(E.from_text(F.col("t"), F.col("e")), F.col("e")).alias("b")).collect()
    assert all(r["t"] == r["b"] or "?" in r["b"] for r in back)


def entry(h, t, done=True, path="p"):
    return (h, path, 1, done, t, t, "local", "fp", "c")


def test_cache(spark, tmp_path):
    c = B.CacheTable(spark, str(tmp_path / "cache"))
    assert not c.exists() and c.read().count() == 0
    c.upsert(spark.createDataFrame([entry("a", 1), entry("b", 1)], B.SCHEMA))
    c.upsert(spark.createDataFrame([entry("a", 5, path="q")], B.SCHEMA))
    assert sorted((r["file_hash"], r["path"]) for r in c.entries().collect()) == [("a", "q"), ("b", "p")]
    assert c.cleanup(spark.createDataFrame([("a",)], "file_hash string")) == 1
    c.invalidate("a")  # the last entry really goes
    assert c.exists() and c.read().count() == 0
    c.clear()
    assert not c.exists()


def test_cache_versions(spark, tmp_path):
    """Readers keep their version; one of two writers is refused; many upserts are compacted; a torn manifest is passed over."""
    c = B.CacheTable(spark, str(tmp_path / "cache"))
    one = lambda k, n: spark.createDataFrame([entry(k, n)], B.SCHEMA)
    c.upsert(one("a", 1))
    before = c.read()
    head = c._head()
    c.upsert(one("a", 2))
    assert before.first()["created_at"] == 1 and c.read().first()["created_at"] == 2
    with pytest.raises(RuntimeError):
        c._publish(one("x", 1), head, head[1])
    for i in range(B.COMPACT + 2):
        c.upsert(one(f"k{i}", i))
    assert c.read().count() == B.COMPACT + 3 and len(c._head()[1]) < B.COMPACT and len(c._manifests()) <= B.KEPT
    (tmp_path / "cache" / "_versions" / "000000000999.json").write_text("")
    c.upsert(one("late", 1))
    assert c.read().where("file_hash = 'late'").count() == 1


def test_backups(spark):
    df = spark.createDataFrame([("a.bak", 0), ("a_1.bak.py", 50), ("a.py", 0), ("bak", 0)], "path string, mtime long")
    assert sorted(r["path"] for r in B.find_backups(df).collect()) == ["a.bak", "a_1.bak.py"]
    assert [r["path"] for r in B.filter_by_age(B.find_backups(df), "mtime", 1, F.lit(86410)).collect()] == ["a.bak"]


def test_config(tmp_path):
    (tmp_path / ".env").write_text('KEY="real-key"\nA=1 # c\nexport B=2\n')
    (tmp_path / ".env.example").write_text("C=3")
    (tmp_path / G.PROJECT_FILE).write_text('target_lang = "EN"\nsource_langs = ["ZH"]\n[filter]\nmin_length = 3\n')
    g = tmp_path / "g.toml"
    g.write_text('[[providers]]\nid = "p"\napi_key = "${KEY}"\nmodels = ["m"]\n[[providers]]\nid = "q"\napi_key = "your-api-key"\nmodels = ["m"]\n')
    sub = tmp_path / "x" / "y"
    sub.mkdir(parents=True)
    glob, proj = G.load(tmp_path, [g], env={})
    assert [p.api_key for p in glob.providers] == ["real-key"] and proj.source_langs == ["zh"] and proj.filter.min_length == 3
    assert G.find_project_file(sub) == tmp_path / G.PROJECT_FILE
    assert G.load_env([tmp_path], {"A": "kept"}) == {"A": "kept", "KEY": "real-key", "B": "2"}
    G.save(proj, tmp_path / "s.toml")
    assert G.read(G.ProjectConfig, tmp_path / "s.toml") == proj
    with pytest.raises(G.ConfigError):
        G.GlobalConfig(providers=[G.Provider(id="a", api_key="k", models=["m"], custom_user_prompt="no")]).validate()
    with pytest.raises(G.ConfigError):
        G.GlobalConfig(providers=[G.Provider(id="a", api_key="test", models=["m"])]).validate()
    assert G.expand({"a": ["$A", "$NO"]}, {"A": "1"}) == {"a": ["1", "$NO"]}
    assert G.merged(G.ProjectConfig(include=["a"]), G.ProjectConfig(target_lang="de")).include == ["a"]


def test_cache_dirs():
    assert B.resolve_dir("local", "/p/") == "/p/.loomtext" and B.resolve_dir("global", "/p", None, "/h") == "/h/.loomtext/cache" and B.resolve_dir("local", "/p", "/d") == "/d"
    assert os.path.basename("x") == "x"


@pytest.fixture(scope="module")
def encoded(tmp_path_factory):
    """A folder of files in five encodings, with matches to locate in them."""
    import datetime

    from tests.conftest import _SPARK as spark

    d = str(tmp_path_factory.mktemp("encoded"))
    zh, ja = "// 此函数检查缓冲区是否仍然有效。\r\n", "// この関数はスナップショットがまだ有効かどうかを確認します。\r\n"
    t = datetime.datetime(2026, 1, 1)
    rows = [("a.c", zh.encode("gb18030")), ("b.c", ja.encode("cp932")), ("c.js", ja.encode("utf-16")), ("d.py", b"\xef\xbb\xbf# " + "检查。\n".encode()), ("e.c", zh.replace("函", "函").encode() + b'"\xff"'), ("f.c", zh.encode("big5", "ignore"))]
    spark.createDataFrame([(p, p.split(".")[1], t, c) for p, c in rows], "path string, ext string, scanned_at timestamp, content binary").write.parquet(f"{d}/source_files.parquet")
    m = [(i, p, "other", r, r, {"line": 1, "column": 1, "offset": 0}) for i, (p, r) in enumerate([("a.c", zh[:-2]), ("b.c", ja[:-2]), ("c.js", ja[:-2]), ("d.py", "# 检查。")])]
    spark.createDataFrame(m, "match_id long, path string, category string, extracted_text string, raw_match string, position struct<line: int, column: int, offset: int>").write.parquet(f"{d}/verify_matches.parquet")
    return d


def test_files_of_any_encoding_are_read(spark, encoded):
    from loomtext.plans import q_code, q_rel

    got = {r["path"]: r["text"] for r in q_code.texts(spark, encoded).collect()}
    assert len(got) == 6 and got["a.c"].startswith("// 此函数检查") and got["b.c"].startswith("// この関数は") and got["c.js"] == got["b.c"] and got["d.py"] == "# 检查。\n"
    assert got["e.c"].endswith('。\r\n"�"')
    assert {r["ext"]: r["n"] for r in q_code.lex_all(spark, encoded).where("kind = 'line_comment'").collect()} == {"c": 4, "js": 1, "py": 1}
    assert q_code.unit_counts(spark, encoded).agg(F.sum("n_files")).first()[0] >= 5
    assert q_code.lex_agree(spark, encoded).count() == 0
    assert {r["match_id"] for r in q_rel.located_all(spark, encoded).where("exact AND first = 1").collect()} == {0, 1, 2, 3}
    assert q_rel.applied_units(spark, encoded).agg(F.sum("n")).first()[0] == 6
    assert {r["path"] for r in q_code.custom_patterns_all(spark, encoded).collect()} == {"e.c"}
