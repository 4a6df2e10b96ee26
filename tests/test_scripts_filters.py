import pytest
from pyspark.sql import functions as F

from loomtext.functions import scripts as S
from loomtext.operators import filters as P


def column(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


T = F.col("t")


def test_language_filter_goldens(spark):
    got = column(spark, ["Hello", "你好"], P.language_filter(T, [], "EN"))
    assert [x for x, in got] == [False, True]
    got = column(spark, ["10", "$100", "(123)", None, ""], P.language_filter(T, ["AUTO"], "EN"))
    assert not any(x for x, in got)


def test_pattern_filter_goldens(spark):
    texts = ["TODO: fix this", "Copyright 2024", "Hello world", "func(arg1, arg2)", "array[index]", "`code`", "Version 2.0", "Mr. Smith"]
    got = [x for x, in column(spark, texts, P.pattern_filter(T))]
    assert got == [False, False, True, False, False, False, True, True]
    s = "支持数组索引访问（如 items[0].name）"
    assert column(spark, [s], P.pattern_filter(T), P.pattern_filter(T, check_code=False)) == [(False, True)]


def test_placeholders(spark):
    got = [x for x, in column(spark, ["Hello %s", "Value: {name}", "Args: $1 $2", "Plain text"], P.contains_placeholder(T))]
    assert got == [True, True, True, False]


def test_unicode_calls_count_as_code(spark):
    assert column(spark, ["函数(x)"], P.contains_code(T)) == [(True,)]


def test_detect(spark):
    got = column(spark, ["こんにちは", "안녕하세요", "Привет мир", "", None, "!!"], S.detect(T)["script"], S.primary(S.detect(T)))
    assert got == [("Cjk", "JA"), ("Cjk", "KO"), ("Cyrillic", "RU"), ("Unknown", None), (None, None), ("Unknown", None)]


def test_regional_english_is_latin():
    assert S.script_of_code("en-US") == "Latin" and S.script_of_code("xx") is None


def test_allowed_groups(spark):
    assert S.allowed_langs(["CJK", "en", "ZH"]) == ["ZH", "JA", "KO", "EN"]
    assert column(spark, ["日本の"], F.size(S.cjk_langs(T, ["KO"]))) == [(0,)]


def test_long_text_samples(spark):
    far = "x" * 500 + "中"
    mid = "x" * 250 + "中" + "x" * 350
    got = column(spark, [far, mid, "x" * 700, None], S.contains_target(T, ["zh"]), S.quick_has(T, "chinese"))
    assert got == [(True, False), (True, False), (False, False), (None, None)]


def test_invalid_pattern_is_a_config_error():
    with pytest.raises(ValueError):
        P.FilterConfig(exclude_patterns=["("]).validate()


def test_presets_and_limits():
    assert P.capped_length(0, None) == 100_000 and P.capped_length(50, 0) == 50 and P.capped_length(50, 20) == 20
    cfg, src, target = P.verify_filter()
    assert cfg.min_length == 1 and not cfg.detect_code_patterns and target == "XX"


def test_composite_handles_nulls_and_empty_tables(spark):
    assert column(spark, [None, "", " ", "你好世界"], P.composite(T)) == [(False,), (False,), (False,), (True,)]
    assert spark.createDataFrame([], "t string").select(P.composite(T)).collect() == []


def test_checksums_and_common_languages(spark):
    """The checksum of a text's bytes; U4: the Latin languages that are allowed, in the fixed order."""
    import zlib

    from pyspark.sql import functions as F

    from loomtext.functions import scalars as C
    from loomtext.functions import scripts as S

    texts = ["", "abc", "größer 世界", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.crc32(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [None if t is None else zlib.crc32(t.encode()) for t in texts]
    one = spark.range(1).select(S.latin_langs().alias("all"), S.latin_langs(["FR", "ZH", "DE", "FR"]).alias("some"), S.latin_langs(["KO"]).alias("none"), S.latin_langs([]).alias("empty")).first()
    assert one["some"] == [k for k in one["all"] if k in ("FR", "DE")] and len(one["some"]) == 2 and one["none"] == one["empty"] == []
