"""Queries over texts: scripts, languages and filters, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import scripts as S
from loomtext.operators import filters as P
from loomtext.session import table

#: Texts the tables lack, added to them on both sides.
EXTRA = [
    "Hello", "你好", "10", "$100", "(123)", "TODO: fix this", "Copyright 2024", "Hello world", "func(arg1, arg2)", "array[index]", "`code`",
    "Version 2.0", "Mr. Smith", "Hello %s", "Value: {name}", "Args: $1 $2", "Plain text", "こんにちは", "안녕하세요", "Привет мир", "Привіт, це їжак і ґанок",
    "مرحبا بالعالم", "שלום עולם", "Γειά σου", "see https://a.example/x", "mail me@example.org", "", "   ", "!!! ???", "100%", "ℵ0", "ﾊﾛｰ", "Ўзбек", "Объект", "a{b c}d",
]
_VALUES = ", ".join("('" + t.replace("'", "''") + "')" for t in EXTRA)

TEXTS_SQL = f"""texts AS (
  SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT -row_number() OVER (ORDER BY t) AS id, t AS text FROM (VALUES {_VALUES}) v(t))"""


def texts(spark, sf_dir):
    """(id, text): all documents and the extra texts."""
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(sorted(EXTRA, key=lambda x: x.encode()))], "id long, text string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(extra)


def _has(e, ranges):
    return f"regexp_matches({e}, '[{ranges}]')"


def _sample(e, n=128):
    return f"left(regexp_replace({e}, '[{S.WS}]+', '', 'g'), {n})"


def _count(e, ranges):
    return f"len(regexp_extract_all({e}, '[{ranges}]'))"


SMP = "smp AS (SELECT *, " + _sample("text") + " AS s FROM texts)"
IS_LATIN = f"CASE WHEN text IS NULL THEN NULL ELSE coalesce({_count('s', S.LATIN)} / nullif(length(s) - {_count('s', S.SKIPPED)}, 0)::DOUBLE > 0.7, false) END"


def _script(e):
    arms = [("Cjk", S.CJK), ("Arabic", S.ARABIC), ("Hebrew", S.HEBREW), ("Greek", S.GREEK), ("Cyrillic", S.CYRILLIC), ("Latin", S.LATIN)]
    return "CASE " + " ".join(f"WHEN {_has(e, r)} THEN '{n}'" for n, r in arms) + f" WHEN {e} IS NOT NULL THEN 'Unknown' END"


def script_flags(spark, sf_dir):
    """sample tests of eight scripts."""
    t = texts(spark, sf_dir)
    return t.select("id", *[S.quick_has(F.col("text"), k).alias("has_" + k) for k in S.CLASS])


SCRIPT_FLAGS = f"WITH {TEXTS_SQL}, {SMP} SELECT id, " + ", ".join(f"{_has('s', r)} AS has_{k}" for k, r in S.CLASS.items()) + " FROM smp"


def latin_texts(spark, sf_dir):
    """Share of Latin characters in a sample of 128."""
    t = texts(spark, sf_dir)
    return t.select("id", S.is_latin(F.col("text")).alias("is_latin"), F.length(S.sample(F.col("text"))).cast("long").alias("sampled"))


LATIN_TEXTS = f"WITH {TEXTS_SQL}, {SMP} SELECT id, {IS_LATIN} AS is_latin, length(s) AS sampled FROM smp"


def script_of_text(spark, sf_dir):
    """script by sample and by spots."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", S.quick_script(c).alias("quick"), S.sampled_script(c).alias("spotted"), S.meaningful(c).alias("meaningful"))


SCRIPT_OF_TEXT = f"""WITH {TEXTS_SQL}, {SMP},
sp AS (SELECT *, CASE WHEN text IS NULL THEN NULL ELSE list_transform(range(1, least(length(text), 901) + 1, 100), lambda i: substring(text, i::BIGINT, 1)) END AS spots FROM smp)
SELECT id, {_script('s')} AS quick,
  CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 32 THEN {_script('s')}
       ELSE coalesce(list_filter(list_transform(spots, lambda x: {_script('x')}), lambda y: y <> 'Unknown')[1], 'Unknown') END AS spotted,
  CASE WHEN text IS NULL THEN NULL ELSE len(list_filter(spots, lambda x: NOT {_has('x', S.SKIPPED + S.WS)})) > 0 END AS meaningful
FROM sp"""


def language_info(spark, sf_dir):
    """Script, languages and confidence of whole texts."""
    t = texts(spark, sf_dir).withColumn("i", S.detect(F.col("text")))
    return t.select("id", "i.script", F.array_join("i.langs", ",").alias("langs"), "i.has_chars", F.round("i.confidence", 9).alias("confidence"), S.primary(F.col("i")).alias("primary_lang"), S.contains_lang(F.col("i"), "ja").alias("holds_ja"))


_ONLY = r"\x{4E00}-\x{9FFF}" + S.KANA + r"\x{AC00}-\x{D7AF}\x{0600}-\x{06FF}" + S.HEBREW + r"\x{0370}-\x{03FF}\x{0400}-\x{04FF}" + S.LATIN
_DETECT_SQL = f"""det AS (SELECT id, text,
  CASE WHEN text IS NULL THEN NULL WHEN NOT {_has('text', _ONLY)} THEN 'Unknown' WHEN {_has('text', S.KANA + S.HANGUL + S.UNIFIED)} THEN 'Cjk' WHEN {_has('text', r'\x{0600}-\x{06FF}')} THEN 'Arabic'
       WHEN {_has('text', S.HEBREW)} THEN 'Hebrew' WHEN {_has('text', S.GREEK)} THEN 'Greek' WHEN {_has('text', S.CYRILLIC)} THEN 'Cyrillic' WHEN {_has('text', S.LATIN)} THEN 'Latin' ELSE 'Unknown' END AS script,
  list_filter([CASE WHEN {_has('text', S.KANA)} THEN 'JA' END, CASE WHEN {_has('text', S.HANGUL)} THEN 'KO' END, CASE WHEN {_has('text', S.UNIFIED)} AND NOT {_has('text', S.KANA)} THEN 'ZH' END], lambda x: x IS NOT NULL) AS cjk,
  list_filter([CASE WHEN {_has('text', 'ҐґЄєЇї')} THEN 'UK' END, CASE WHEN {_has('text', 'Ўў')} THEN 'BE' END, CASE WHEN {_has('text', 'Ъъ')} THEN 'BG' END], lambda x: x IS NOT NULL) AS cyr
  FROM texts),
inf AS (SELECT *, CASE script WHEN 'Cjk' THEN cjk WHEN 'Arabic' THEN ['AR'] WHEN 'Hebrew' THEN ['HE'] WHEN 'Greek' THEN ['EL']
  WHEN 'Cyrillic' THEN CASE WHEN len(cyr) > 0 THEN cyr ELSE ['RU'] END WHEN 'Latin' THEN {S.LATIN_LANGS!r} WHEN 'Unknown' THEN []::VARCHAR[] END AS langs FROM det)"""
LANGUAGE_INFO = f"""WITH {TEXTS_SQL}, {_DETECT_SQL}
SELECT id, script, array_to_string(langs, ',') AS langs, script <> 'Unknown' AS has_chars,
  round(CASE WHEN text IS NULL THEN NULL WHEN script IN ('Arabic', 'Hebrew', 'Greek') THEN 1.0 WHEN script = 'Unknown' THEN 0.0
       ELSE least(least(length(regexp_replace(text, '[{S.WS}]+', '', 'g')) / 100.0::DOUBLE, 1.0) * 0.5 + 0.5 / len(langs), 1.0) END, 9) AS confidence,
  langs[1] AS primary_lang, CASE WHEN langs IS NULL THEN NULL ELSE list_contains(langs, 'JA') END AS holds_ja FROM inf"""


def detector_filter(spark, sf_dir):
    """F32: translate by detected language, for three settings."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", *[F.coalesce(S.detector_should_translate(c, s, g), F.lit(False)).alias(n) for n, s, g in (("any_to_en", [], "en"), ("auto_to_zh", ["AUTO"], "ZH"), ("ru_ja_to_en", ["ru", "JA"], "EN"))])


DETECTOR_FILTER = f"""WITH {TEXTS_SQL}, {_DETECT_SQL}
SELECT id, coalesce(script <> 'Unknown' AND (script <> 'Latin' OR NOT list_contains(langs, 'EN')), false) AS any_to_en,
  coalesce(script <> 'Unknown' AND (script <> 'Cjk' OR (len(langs) > 0 AND NOT list_contains(langs, 'ZH'))), false) AS auto_to_zh,
  coalesce(script <> 'Unknown' AND (list_contains(langs, 'RU') OR script = 'Cyrillic' OR list_contains(langs, 'JA') OR script = 'Cjk'), false) AS ru_ja_to_en FROM inf"""


def script_codes(spark, sf_dir):
    """Script of every label of the responses."""
    r = table(spark, sf_dir, "translate_responses").select(F.lower("source_lang").alias("code")).distinct()
    return r.select("code", S.script_of(F.col("code")).alias("script"))


SCRIPT_CODES = "SELECT DISTINCT lower(source_lang) AS code, CASE " + " ".join(
    f"WHEN upper(source_lang) IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in S.SCRIPT_OF.items()) + " END AS script FROM translate_responses"


def target_samples(spark, sf_dir):
    """Languages of interest by head, middle and tail."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", S.contains_target(c, ["zh", "ru"]).alias("zh_or_ru"), S.contains_target(c, []).alias("any"), S.contains_target(c, ["xx"]).alias("unknown_code"))


def _target(e):
    return f"({_has(_sample(e), S.HAN)} OR {_has(_sample(e), S.CYRILLIC)})"


TARGET_SAMPLES = f"""WITH {TEXTS_SQL} SELECT id, CASE WHEN length(text) <= 256 THEN {_target('text')}
  ELSE {_target('left(text, 128)')} OR {_target('substring(text, (length(text) - 256) // 2 + 1, 128)')} OR {_target('right(text, 128)')} END AS zh_or_ru,
  CASE WHEN text IS NOT NULL THEN true END AS "any", CASE WHEN text IS NOT NULL THEN true END AS unknown_code FROM texts"""


def length_checks(spark, sf_dir):
    """Byte lengths."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", P.length_filter(c, 3, 200).alias("ok"), P.capped_length_column(F.octet_length(c), F.lit(500)).cast("long").alias("capped"))


LENGTH_CHECKS = f"WITH {TEXTS_SQL} SELECT id, coalesce(regexp_matches(text, '[^{S.WS}]') AND strlen(text) BETWEEN 3 AND 200, false) AS ok, coalesce(least(nullif(strlen(text), 0), 500), 100000)::BIGINT AS capped FROM texts"

_LETTER_SQL = f"regexp_matches(regexp_replace(text, '[{P.SPECIAL}]', '', 'g'), '[{P.LETTERS}]')"
_DIGSYM = f"regexp_matches(text, '\\A[{S.WS}{P.PUNCTUATION}0-9]*\\z')"


def content_checks(spark, sf_dir):
    """Symbols, digits and letters."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", P.only_symbols(c).alias("symbols"), P.only_digits_and_symbols(c).alias("digits_symbols"), P.only_digits(c).alias("digits"), P.is_letter(c).alias("letter"), P.is_special(c).alias("special"), P.content_filter(c).alias("ok"))


CONTENT_CHECKS = f"""WITH {TEXTS_SQL} SELECT id, regexp_matches(text, '\\A[{S.WS}{P.PUNCTUATION}]*\\z') AS symbols, {_DIGSYM} AS digits_symbols,
  regexp_matches(text, '\\A[{S.WS}0-9]*\\z') AS digits, {_LETTER_SQL} AS letter, regexp_matches(text, '[{P.SPECIAL}]') AS special, coalesce(NOT {_DIGSYM} AND {_LETTER_SQL}, false) AS ok FROM texts"""

# RE2 has ASCII classes only: word characters are spelled out, and word boundaries by what stands beside.
_W = r"[\pL\pM\pN\p{Pc}]"
_PH = [r"%[sdvf]", rf"\$\p{{Nd}}{{1,2}}(?:[^\pL\pM\pN\p{{Pc}}]|\z)", r"\$\{[^}]*\}", r"\{[a-zA-Z_][a-zA-Z0-9_]*\}"]
_CD = [rf"{_W}+\([^)]*\)", rf"{_W}+\[[^\]]*\]", r"`[^`]+`"]
_KW = rf"(?:\A|[^\pL\pM\pN\p{{Pc}}])(?:{'|'.join(P.KEYWORDS)})(?:[^\pL\pM\pN\p{{Pc}}]|\z)"


def _or(e, ps):
    return "(" + " OR ".join(f"regexp_matches({e}, '{p}')" for p in ps) + ")"


def _pattern_sql(code=True):
    return f"coalesce(NOT (regexp_matches(text, '{P.URL}') OR {_or('text', _PH)} OR regexp_matches(text, '{_KW}')" + (f" OR {_or('text', _CD)}" if code else "") + "), false)"


def pattern_checks(spark, sf_dir):
    """Addresses, placeholders, keywords and code patterns."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select("id", P.contains_placeholder(c).alias("placeholder"), P.contains_code(c).alias("code"), P.protected(c).alias("protected"), P.pattern_filter(c).alias("ok"), P.pattern_filter(c, check_code=False).alias("ok_comment"))


PATTERN_CHECKS = f"""WITH {TEXTS_SQL} SELECT id, {_or('text', _PH)} AS placeholder, {_or('text', _CD)} AS code,
  regexp_matches(text, '{P.URL}') OR {_or('text', _PH[:3] + [r'{[^}]*}'.replace('{[', chr(92) + '{[').replace('*}', '*' + chr(92) + '}')])} AS protected, {_pattern_sql()} AS ok, {_pattern_sql(False)} AS ok_comment FROM texts"""

_TRANSLATABLE = rf"regexp_matches(text, '[\pL\p{{Nl}}\p{{Other_Alphabetic}}{S.CJK}{S.ARABIC}{S.CYRILLIC}{S.HEBREW}{S.GREEK}]')".replace(r"\p{Other_Alphabetic}", "")
_TO_EN = f"({IS_LATIN} AND NOT {_has('s', S.CJK)})"


def language_checks(spark, sf_dir):
    """Language filters for several settings."""
    t, c = texts(spark, sf_dir), F.col("text")
    return t.select(
        "id", P.is_target_language(c, "en").alias("is_en"), P.is_target_language(c, "ja").alias("is_ja"), P.translatable(c).alias("translatable"),
        P.language_filter(c, [], "EN").alias("any_to_en"), P.language_filter(c, ["auto"], "en").alias("auto_to_en"), P.language_filter(c, ["zh", "ko"], "en").alias("zh_ko_to_en"),
        P.language_only_filter(c, ["ru", "ja"]).alias("only_ru_ja"), P.language_only_filter(c, []).alias("only_none"),
    )


LANGUAGE_CHECKS = f"""WITH {TEXTS_SQL}, {SMP} SELECT id, {_TO_EN} AS is_en, {_has('s', S.KANA)} AND NOT ({IS_LATIN}) AS is_ja, {_TRANSLATABLE} AS translatable,
  coalesce({_TRANSLATABLE} AND NOT {_TO_EN}, false) AS any_to_en, coalesce({_TRANSLATABLE} AND NOT {_TO_EN}, false) AS auto_to_en,
  coalesce({_TRANSLATABLE} AND ({_has('s', S.HAN)} OR {_has('s', S.HANGUL)}), false) AS zh_ko_to_en,
  coalesce(({_has('s', S.CYRILLIC)} OR {_has('s', S.KANA)}) AND NOT (regexp_matches(text, '{P.URL}') OR {_or('text', _PH[:3])} OR regexp_matches(text, '\\{{[^}}]*\\}}')), false) AS only_ru_ja, false AS only_none FROM smp"""


def filter_reasons(spark, sf_dir):
    """The composite filter, with the filter that rejects."""
    t = texts(spark, sf_dir)
    r = t.select("id", P.reason(F.col("text")).alias("reason"), P.composite(F.col("text")).alias("kept"))
    return r.groupBy("reason", "kept").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_LEN = f"coalesce(regexp_matches(text, '[^{S.WS}]') AND strlen(text) BETWEEN 2 AND 100000, false)"
FILTER_REASONS = f"""WITH {TEXTS_SQL}, {SMP}, r AS (SELECT id, CASE WHEN NOT {_LEN} THEN 'length' WHEN NOT coalesce({_TRANSLATABLE} AND NOT {_TO_EN}, false) THEN 'language'
  WHEN NOT {_pattern_sql()} THEN 'pattern' WHEN NOT coalesce(NOT {_DIGSYM} AND {_LETTER_SQL}, false) THEN 'content' ELSE 'kept' END AS reason FROM smp)
SELECT reason, reason = 'kept' AS kept, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1, 2"""


def match_filters(spark, sf_dir):
    """matches by name, extension, category and text."""
    m = P.match_filter(table(spark, sf_dir, "verify_matches"), "comment", "PY", "other", "e")
    return m.select("match_id", "path").distinct()


MATCH_FILTERS = r"SELECT DISTINCT match_id, path FROM verify_matches WHERE contains(pattern_name, 'comment') AND lower(regexp_extract(path, '\.([^./]+)$', 1)) = 'py' AND category = 'other' AND contains(extracted_text, 'e')"


def function_lists(spark, sf_dir):
    """default names by category and language."""
    rows = [(k, lang, i, n) for k in ("error_handling", "output", "variable", "property") for lang in ("javascript", "typescript", "python", "rust", "go", "java", "csharp", "lua") for i, n in enumerate(P.default_patterns(lang, k))]
    return spark.createDataFrame(rows, "category string, lang string, pos int, name string").groupBy("category", "lang").agg(F.count("*").alias("n"))


FUNCTION_LISTS = """SELECT * FROM (VALUES ('error_handling', 'javascript', 8), ('error_handling', 'typescript', 8), ('error_handling', 'python', 8), ('error_handling', 'rust', 7), ('error_handling', 'go', 3), ('error_handling', 'java', 5), ('error_handling', 'csharp', 4),
  ('output', 'javascript', 7), ('output', 'typescript', 7), ('output', 'python', 7), ('output', 'rust', 5), ('output', 'go', 8), ('output', 'java', 5), ('output', 'csharp', 5)) v(category, lang, n)
  UNION ALL SELECT c, l, n FROM (VALUES ('variable', 6), ('property', 9)) a(c, n), (VALUES ('javascript'), ('typescript'), ('python'), ('rust'), ('go'), ('java'), ('csharp'), ('lua')) b(l)"""


def function_classes(spark, sf_dir):
    """calls in code by the category of their name."""
    call = F.explode(F.regexp_extract_all("extracted_text", F.lit(r"([A-Za-z_.]+)\("), F.lit(1)))
    c = table(spark, sf_dir, "verify_matches").where(F.lower("category") == "code").select(call.alias("name"))
    kind = P.classify_function(F.col("name"), FN)
    return c.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", kind.alias("kind")).where("kind IS NOT NULL")


#: An example set of function categories.
FN = {"error": ["Error", "TypeError", "panic", "raise", "errors.New", "ValueError"], "format": ["format", "printf", "fmt.Sprintf"], "log": ["console.warn", "log.Println", "log.warning", "notify", "print"], "debug": ["dbg", "debug"], "test": ["assert", "test"]}
FUNCTION_CLASSES = r"""SELECT name, count(*) AS n, any_value(kind) AS kind FROM (SELECT name, CASE """ + " ".join(
    f"WHEN name IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in FN.items()) + r""" END AS kind FROM
  (SELECT unnest(regexp_extract_all(extracted_text, '([A-Za-z_.]+)\(', 1)) AS name FROM verify_matches WHERE lower(category) = 'code')) WHERE kind IS NOT NULL GROUP BY name"""

QUERIES = {
    "script_flags": (script_flags, SCRIPT_FLAGS),
    "latin_texts": (latin_texts, LATIN_TEXTS),
    "script_of_text": (script_of_text, SCRIPT_OF_TEXT),
    "language_info": (language_info, LANGUAGE_INFO),
    "detector_filter": (detector_filter, DETECTOR_FILTER),
    "script_codes": (script_codes, SCRIPT_CODES),
    "target_samples": (target_samples, TARGET_SAMPLES),
    "length_checks": (length_checks, LENGTH_CHECKS),
    "content_checks": (content_checks, CONTENT_CHECKS),
    "pattern_checks": (pattern_checks, PATTERN_CHECKS),
    "language_checks": (language_checks, LANGUAGE_CHECKS),
    "filter_reasons": (filter_reasons, FILTER_REASONS),
    "match_filters": (match_filters, MATCH_FILTERS),
    "function_lists": (function_lists, FUNCTION_LISTS),
    "function_classes": (function_classes, FUNCTION_CLASSES),
}
