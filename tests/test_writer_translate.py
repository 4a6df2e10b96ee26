import os

import pytest
from pyspark.sql import functions as F

from loomtext.operators import routing as T
from loomtext.operators import translate as X
from loomtext.operators import writer as W


def test_replace_in_raw():
    assert W.replace_in_raw('println!("Hello world");', "Hello world", "你好世界") == 'println!("你好世界");'
    raw = "/**\n * 第一行\n * 第二行\n */"
    assert W.replace_in_raw(raw, "第一行\n第二行", "First\nSecond") == "/**\n * First\n * Second\n */"
    assert W.replace_in_raw("// a\n// b", "a\nb", "x\ny") == "// x\n// y"
    assert W.replace_in_raw("x", "a\nb", "y") == "x"


def test_format_translation():
    assert W.format_translation("/*\n * a\n * b\n */", "x\ny") == "/*\n * x\n * y\n */"
    assert W.format_translation("/* a */", "/* z */") == "/* z */"
    with pytest.raises(W.Loss):
        W.format_translation("/*\n * a\n */", "x\ny", strict=True)
    assert W.format_translation('    """\n    a\n    b\n    """', "x\ny") == '    """\n    x\n    y\n    """'
    assert W.format_translation("// a\n// b\n", "x\ny") == "// x\n// y\n"
    assert W.format_translation("// a\n//\n// b", "x\ny") == "// x\n// \n// y"


def test_apply_translations():
    text = "// 你好\r\nlet a = '世界';\r\n"
    units = [{"content": "你好", "translated": "Hello", "raw_match": "// 你好"}, {"content": "世界", "translated": "World", "raw_match": "'世界'"}]
    assert W.apply_translations(text, units) == "// Hello\r\nlet a = 'World';\r\n"
    assert W.apply_translations(text, [{"content": "x", "translated": "y", "raw_match": "absent"}]) == text
    assert W.apply_translations(text, [{"content": "x", "translated": None, "raw_match": "你好"}]) == text
    same = "# a\n# a\n"
    assert W.apply_translations(same, [{"content": "a", "translated": "b", "raw_match": "# a", "start": 4}]) == "# a\n# b\n"
    assert W.apply_lines("x = 'é'", [{"content": "é", "translated": "e", "raw_match": None, "column": 6, "end_column": 8}]) == "x = 'e'"


def test_offsets():
    assert W.lf_to_crlf_offset("a\r\nb", 2) == 3 and W.detect_ending("a\nb") == "\n"
    assert W.splice("abcdef", [(4, 5, "E"), (0, 2, "X"), (1, 3, "no")]) == "XcdEf"


def test_apply_and_write(spark, tmp_path):
    files = spark.createDataFrame([("a/x.py", "# 你好\n"), ("y.py", "z"), ("../bad.py", "# 你好\n"), ("n.py", None)], "path string, text string")
    units = spark.createDataFrame([(p, "你好", "Hello", "# 你好", 1, 1) for p in ("a/x.py", "../bad.py")], "path string, content string, translated string, raw_match string, line int, column int")
    a = W.apply_units(files, units).cache()
    assert {r["path"]: r["changed"] for r in a.collect()} == {"a/x.py": True, "y.py": False, "../bad.py": True, "n.py": False}
    res = {r["path"]: (r["success"], r["error"]) for r in W.write_files(a, str(tmp_path / "out"), str(tmp_path / "bak")).collect()}
    assert res["a/x.py"] == (True, None) and res["../bad.py"][0] is False
    goal = tmp_path / "out" / "a" / "x.py"
    assert goal.read_text() == "# Hello\n"
    os.chmod(goal, 0o640)
    W.write_files(a.where("path = 'a/x.py'"), str(tmp_path / "out"), str(tmp_path / "bak")).collect()
    assert oct(goal.stat().st_mode)[-3:] == "640" and len(list((tmp_path / "bak").iterdir())) == 1
    assert W.preview(a).count() == 2


def test_routing(spark):
    assert T.schedule({"a": 5, "b": 1, "c": 1}).count("a") == 5 and len(T.schedule({"a": 5, "b": 1, "c": 1})) == 7
    longest = max(len(x) for x in "".join(T.schedule({"a": 2, "b": 2})).replace("b", " ").split())
    assert longest == 1
    df = spark.range(2000).select(T.weighted_random(F.col("id"), {"a": 3, "b": 1}).alias("p"))
    n = df.where("p = 'a'").count()
    assert 1350 < n < 1650
    ev = spark.createDataFrame([("x", i, s) for i, s in enumerate([False, True, False, False, True, True])] + [("y", 0, False)] + [("z", i, False) for i in range(3)], "p string, o int, success boolean")
    assert {r["p"]: r["healthy"] for r in T.health(ev, ["p"], ["o"]).collect()} == {"x": True, "y": True, "z": False}
    rng = __import__("random").Random(2)
    many = [(f"p{i % 5}", i, rng.random() < 0.5) for i in range(400)]
    want = {}
    for p, _, ok in many:
        want.setdefault(p, X.Health()).record(ok)
    got = T.health(spark.createDataFrame(many, "p string, o int, success boolean"), ["p"], ["o"]).collect()
    assert {r["p"]: r["healthy"] for r in got} == {k: h.healthy for k, h in want.items()}
    assert T.failover_order(["a", "b", "c"], "a", 1) == ["b"]
    tr = spark.createDataFrame([("l", "llm", True), ("d", "deeplx", False), ("t", "tencent", True)], "id string, kind string, healthy boolean")
    assert T.preferred(tr).first()["id"] == "t"


class Flaky:
    name, max_input_chars = "flaky", 0

    def translate(self, texts, source, target):
        raise X.TransportError("down")


def test_service_fails_over_and_keeps_originals():
    s = X.Service([Flaky(), X.DictionaryProvider({"a": "b"})], options=X.Options(batch_size=2))
    assert [r[0] for r in s.batch(["a", "z"], "en", "de")] == ["b", "z"]
    assert X.Service([Flaky()]).one("q", "en", "de") == ("q", None, "down")
    h = X.Health()
    for ok in (False, True, False, False):
        h.record(ok)
    assert not h.healthy
    h.record(True), h.record(True)
    assert h.healthy


def test_splitting():
    text = "a" * 30 + "\n\n" + "Eins. Zwei! " * 5
    parts = X.split_text(text, 25)
    assert "".join(parts) == text and all(len(p) <= 25 for p in parts)
    s = X.Service([X.EchoProvider()], options=X.Options(split_above=25))
    assert s.one(text, "de", "en")[0] == text


def test_placeholders():
    assert X.placeholders("a ${x {y}} {{b}} ${open") == ["${x {y}}", "{{b}}"]
    p, found = X.protect("${a} and ${a} {{b}}")
    assert p == "[[0]] and [[0]] [[1]]" and X.restore(p, found) == "${a} and ${a} {{b}}"


def test_http_providers():
    sent = []

    def send(url, headers, body):
        sent.append((url, headers))
        return '{"choices": [{"message": {"content": "```\\nHallo [[0]]\\n```"}}]}'

    c = X.ChatProvider("u", "m", ["k1", "k2"], send)
    assert c.translate(["Hello ${x}", "Hello ${y}"], "auto", "de") == ["Hallo ${x}", "Hallo ${y}"]
    assert [h["Authorization"] for _, h in sent] == ["Bearer k1", "Bearer k2"]
    d = X.PlainHttpProvider("http://h/", lambda u, h, b: '{"code": 200, "data": "x"}', "key")
    assert d.translate(["", "a"], "en", "de") == ["", "x"]
    assert not X.available(X.PlainHttpProvider("u", lambda u, h, b: '{"code": 500}'))
    auth, date = X.sign("id", "key", "tmt", "h", "{}", 0)
    assert date == "1970-01-01" and auth.startswith("TC3-HMAC-SHA256 Credential=id/1970-01-01/tmt/tc3_request") and len(auth.rsplit("=", 1)[1]) == 64


def test_signed_provider():
    sent = []

    def send(url, headers, body):
        sent.append((url, headers, body))
        return '{"Response": {"TargetText": "Hallo", "RequestId": "r"}}' if "Hello" in body else '{"Response": {"Error": {"Code": "Limit", "Message": "too many"}}}'

    p = X.SignedProvider("id", "key", send, clock=lambda: 0)
    assert p.translate(["Hello", ""], "EN", "de") == ["Hallo", ""] and len(sent) == 1
    url, headers, body = sent[0]
    assert url == "https://tmt.tencentcloudapi.com" and headers["Authorization"] == X.sign("id", "key", "tmt", "tmt.tencentcloudapi.com", body, 0)[0]
    assert '"Source": "en"' in body and headers["X-TC-Timestamp"] == "0"
    with pytest.raises(X.TransportError, match="Limit: too many"):
        p.translate(["x"], "en", "de")
    with pytest.raises(ValueError):
        p.translate(["x" * 7000], "en", "de")


def test_rate_limit():
    now, slept = [0.0], []
    b = X.TokenBucket(2, lambda: now[0], slept.append)
    b.take(), b.take()
    assert slept == [0.5]


def test_translate_keeps_rows(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}", "en", "de" if i % 2 else None) for i in range(9)], "id int, content string, source_lang string, target_lang string")
    out = X.translate(df, lambda: X.Service([X.DictionaryProvider({"t1": "eins"})], options=X.Options(batch_size=2)))
    got = {r["id"]: r["translated"] for r in out.collect()}
    assert got[1] == "eins" and got[3] is None and got[4] == "t4" and len(got) == 9
    assert X.translate(df.limit(0), lambda: X.Service([X.EchoProvider()])).count() == 0
