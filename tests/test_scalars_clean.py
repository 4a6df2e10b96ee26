from pyspark.sql import functions as F

from loomtext.functions import scalars as C
from loomtext.operators import clean as K


def one(spark, text, *exprs):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*exprs).first())


T = F.col("t")


def test_clean_goldens(spark):
    assert one(spark, "/// 第一行\n/// 第二行\npub fn add(a: i32) {", K.doc_comment(T)) == ("第一行\n第二行",)
    assert one(spark, "/* single line */", K.block_comment(T)) == ("single line",)
    assert one(spark, 'r#"hello "world""#', K.raw_string(T)) == ('hello "world"',)
    assert one(spark, "/**\n * a\n *  b\n */", K.doc_comment(T)) == ("\na\nb",)
    assert one(spark, "#  x ", K.line_comment(T)) == ("x",)


def test_unescape(spark):
    assert K.unescape_text(r"a\n\t\\\q\0") == "a\n\t\\\\q\0"
    assert one(spark, r'"say \"hi\" now"', K.string_literal(T)) == ('say "hi" now',)
    assert one(spark, None, K.string_literal(T)) == (None,)


def test_token_limits(spark):
    assert one(spark, "x", C.max_chars(F.lit(1000), "conservative")) == (480,)
    assert one(spark, "你好abc", C.estimate_tokens(T)) == (150 + 3,)
    assert one(spark, None, C.estimate_tokens(T)) == (None,)


def test_marks_round_trip(spark):
    s = "a %d b %s c %5.2f %%"
    for family in C.FORMATS:
        p = C.protect(T, family)
        assert one(spark, s + " {x} {a:{b}}", C.restore(p["text"], p["originals"], family)) == (s + " {x} {a:{b}}",)


def test_more_than_ten_marks(spark):
    s = " ".join(["%s"] * 12)
    p = C.protect(T, "printf")
    assert one(spark, s, C.restore(p["text"], p["originals"], "printf"), F.size(p["originals"])) == (s, 12)


def test_damaged_markers(spark):
    assert one(spark, "字符串 __PH_0 这里", C.restore_spans(T, F.array(F.lit("${value}")))) == ("字符串 ${value} 这里",)
    assert one(spark, "Error: __PH_0__", F.array_join(C.missing_markers(F.lit("Error: __PH_0__, code: __PH_1__"), T).cast("array<string>"), ",")) == ("1",)


def test_byte_places(spark):
    assert one(spark, "Hello 世界", C.byte_to_char(T, F.lit(9)), C.byte_slice(T, F.lit(6), F.lit(9)), C.byte_slice(T, F.lit(7), F.lit(9)), C.byte_slice(T, F.lit(2), F.lit(99))) == (7, "世", None, None)


def test_line_endings(spark):
    assert one(spark, "a\r\nb\nc", C.line_ending(T), C.with_line_ending(T, F.lit("\r\n")), C.with_line_ending(T, F.lit("\n"))) == ("\r\n", "a\r\nb\r\nc", "a\nb\nc")


def test_lines(spark):
    assert one(spark, "a\r\nb\n", K.lines(T)) == (["a", "b"],)
    assert one(spark, "", K.lines(T)) == ([],)


def test_extraction_rules(spark):
    assert one(spark, ' "q" ', K.extract(T, {"type": "remove_quotes"}), K.extract(T, {"type": "none"})) == ("q", ' "q" ')
    assert one(spark, "f(a, b)", K.extract(T, {"type": "regex", "pattern": r"\((.*)\)", "group": 1})) == ("a, b",)
    assert one(spark, "[x]", K.brackets(T, "square"), K.brackets(T, "other")) == ("x", "[x]")


def test_env_names_do_not_shadow(spark):
    assert one(spark, "$HOME_DIR ${HOME} $HOMER", C.expand_env(T, {"HOME": "h", "HOME_DIR": "d"})) == ("d h $HOMER",)


def test_regions_from_the_right(spark):
    r = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("text")) for a, b, x in ((0, 1, "XX"), (3, 4, ""), (9, 99, "no"))])
    assert one(spark, "abcdef", C.apply_regions(T, r)) == ("XXbcef",)
