import random

import pytest
from pyspark.sql import functions as F

from loomtext import lang_rules as R
from loomtext.operators import lexer as X
from loomtext.operators import machines as Q


def regions(ext, text):
    return [(k, text[c:d]) for k, _, _, c, d, _ in R.scan(text, R.rule_of(ext))]


def test_goldens():
    assert regions("js", "// 这是注释\n") == [("line_comment", "这是注释")]
    assert regions("js", "/* 这是块注释 */") == [("block_comment", "这是块注释")]
    assert [k for k, _ in regions("js", "`外层 ${`内层 ${value}`} 结束`")] == ["template_string"]
    assert [k for k, _ in regions("py", '"""\n这是多行字符串\n第二行\n"""')] == ["doc_comment"]
    assert regions("html", "<!-- a --><b c='d'>") == [("block_comment", "a"), ("string_literal", "d")]
    assert regions("rs", 'r#"hello "world""#') == [("raw_string", 'hello "world"')]


def test_a_prefix_commits_to_its_arm():
    assert regions("py", '"""abc" # c\n') == [("string_literal", ""), ("line_comment", "c")]
    assert regions("c", "/* open // x") == [("line_comment", "x")]
    assert regions("c", "'a\nb // c") == [("line_comment", "c")]  # a quote fails at the line end


def test_unterminated_literals_end_with_the_text():
    assert regions("c", '"abc') == [("string_literal", "ab")]
    assert regions("js", "`a ${b") == [("template_string", "a ${")]


def test_template_placeholders():
    text = "`a ${x + {y: 1}.y} b`"
    (_, a, b, c, d, spans), = R.scan(text, R.rule_of("ts"))
    assert (a, b) == (0, len(text)) and [text[c:d][s:e] for s, e in spans] == ["${x + {y: 1}.y}"]


def test_unknown_extension():
    assert R.rule_of("xyz") is None and R.rule_of(None) is None and R.rule_of(".PY").name == "python"
    assert len(R.RULES) == 23 and R.supported_extensions() == sorted(set(R.supported_extensions()))


def test_jvm_lexer_equals_scanner(spark):
    """Random token soup over all regular rule sets."""
    rng = random.Random(7)
    tokens = ["//", "/*", "*/", "/**", "///", "#", '"', "'", '"""', "'''", "--", "--[[", "]]", "[[", "---", "<!--", "-->", "<#", "#>", "r#", "r\"", "@\"", "\\", "\n", " ", "a", "é", "=begin", "=end", "REM", "::", ";"]
    rows = []
    for r in R.RULES:
        if not r.template:
            rows += [(r.exts[0], "".join(rng.choices(tokens, k=rng.randint(1, 14)))) for _ in range(150)]
    df = spark.createDataFrame(rows, "ext string, text string")
    got = df.select("ext", "text", X.regular_tokens(F.col("text"), F.col("ext")).alias("tokens")).collect()
    for r in got:
        want = [r["text"][a:b] for _, a, b, *_ in R.scan(r["text"], R.rule_of(r["ext"]))]
        assert r["tokens"] == want, (r["ext"], r["text"])


def test_places(spark):
    df = spark.createDataFrame([("p", "py", "é = 1\nx = 'ß' # 世"), ("q", "zz", "# no"), ("r", "py", None)], "path string, ext string, text string")
    got = [(r["idx"], r["kind"], r["content"], r["raw_match"], r["start"]["line"], r["start"]["column"], r["start"]["offset"]) for r in X.lexed(df).orderBy("idx").collect()]
    assert got == [(0, "string_literal", "ß", "'ß'", 2, 6, 12), (1, "line_comment", "世", "# 世", 2, 12, 18)]


def test_units_and_matches(spark):
    df = spark.createDataFrame([("a.py", "py", "# 你好 items[0]\nx = '你好(1)'\n'''文档'''\n")], "path string, ext string, text string")
    u = X.units(df).orderBy("idx").collect()
    assert [(r["node_type"], r["content"]) for r in u] == [("comment", "你好 items[0]"), ("doc_string", "文档")]
    m = X.verify_matches(X.units(df)).orderBy("position.offset").collect()
    assert [(r["pattern_name"], r["category"], r["raw_match"]) for r in m] == [("comment", "other", "# 你好 items[0]"), ("docstring", "other", "'''文档'''")]


def test_custom_patterns(spark):
    df = spark.createDataFrame([("a.py", "py", "# TODO: Implement this function\n# TODO: Add error handling\n"), ("b.js", "js", "TODO: x")], "path string, ext string, text string")
    p = [{"name": "todo", "regex": r"TODO:\s*(.+)", "group": 1, "extensions": ["py"]}, {"name": "any", "regex": "TODO", "extensions": ["*"]}]
    got = [(r["path"], r["content"], r["start"]["line"]) for r in X.custom_matches(df, p).orderBy("path", "idx").collect()]
    assert got == [("a.py", "Implement this function", 1), ("a.py", "Add error handling", 2), ("b.js", "TODO", 1)]


def test_state_machine(spark):
    b = Q.MachineBuilder("t").initial("call").state("call", r't\("[a-z]+",\s*').state("text", r'"([^"]*)"', 1).transition("call", "text").accepting("text").build()
    assert [x for _, x, _, _ in b.find('t("hello", "Hello, World!") t("goodbye", "Goodbye!") 世界')] == ["Hello, World!", "Goodbye!"]
    df = spark.createDataFrame([("p", "js", 't("a", "你好")'), ("q", "js", None)], "path string, ext string, text string")
    assert [r["content"] for r in Q.machine_matches(df, b).collect()] == ["你好"]
    with pytest.raises(ValueError):
        Q.Machine("x", "none", ["a"], [Q.State("a", "a")])
    with pytest.raises(ValueError):
        Q.MachineBuilder("x").initial("a").state("a", "a").build()


def test_a_machine_has_no_limit_of_steps_and_always_ends():
    long = Q.Machine("x", "a", ["b"], [Q.State("a", "a", None, False, [("b", None)]), Q.State("b", "b", None, True, [("a", None)])])
    assert long.find("ab" * 1000)[0][2:] == (0, 2000)
    idle = Q.Machine("x", "a", ["a"], [Q.State("a", "z*", None, True, [("a", None)])])
    assert idle.find("zzy")[0][:1] == ("",) or idle.find("zzy")


def test_dedup_keeps_the_first_branch(spark):
    s = "path string, idx int, start_offset int, end_offset int, content string"
    a = spark.createDataFrame([("p", 0, 0, 3, "x"), ("p", 1, 0, 3, "x")], s)
    b = spark.createDataFrame([("p", 0, 0, 3, "x"), ("p", 1, 5, 6, "y")], s)
    got = sorted((r["branch"], r["content"]) for r in X.merged_units(a, b).collect())
    assert got == [(0, "x"), (0, "x"), (1, "y")]


def test_tokens_of_all_file_types(spark):
    """Every file type with regions has its tokens, and plain ones have those of the SQL's query."""
    from loomtext.plans import q_code

    d = "/root/testdata/sf0.001"
    every, plain = q_code.lex_tokens_all(spark, d), q_code.lex_tokens(spark, d)
    assert {r["ext"] for r in every.select("ext").distinct().collect()} == {r["ext"] for r in q_code.lex_all(spark, d).select("ext").distinct().collect()} > set(q_code.PLAIN_EXTS) & {"c", "rb", "sh"}
    assert {"py", "js", "ts", "rs", "go", "java"} <= {r["ext"] for r in every.select("ext").distinct().collect()}
    assert plain.count() > 0 and plain.exceptAll(every).count() == 0


def test_regions_inside_the_jvm_against_the_scanner(spark):
    """Kinds, contents and raw texts of both lexers over the same files."""
    from pyspark.sql import functions as F

    texts = ["// a\n/* b */ /** c */ /// d\n\"e\" 'f' \"g\\\"", "# a\n\"\"\"b\"\"\" r\"c\" r'd' r\"\"\"e\"\"\"", "-- a\n--- b\n--[[ c ]] [[d]]", "r#\"a\"# r\"b\" /**/ /* */ /***/", "<!-- a --><b c=\"d\">", "@\"a\" @'b'", "=begin x =end # y", "//", "/* a", "\"", "", "REM a\n:: b", "{# `t${`u`}` #} `v"]
    rows = [(i, e, t) for i, (t, e) in enumerate((t, e) for t in texts for r in R.RULES for e in r.exts[:1])] + [(-1, "py", None), (-2, "unknown", "# a"), (-3, None, "# a")]
    files = spark.createDataFrame(rows, "id int, ext string, text string")
    a, b = ({(r["id"], r["idx"], r["kind"], r["content"], r["raw_match"]) for r in X.lexed(files, places=p).collect()} for p in (True, False))
    assert a == b and len(a) > 100
