"""Scripts and languages of texts as Column expressions.

Every function maps Columns to a Column and stays inside whole-stage code generation. Null
texts give null; empty and blank texts have no characters and so no script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points, in a form that Java, RE2 and Python's regex understand.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
UNIFIED = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}"
KANA = HIRAGANA + KATAKANA
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
CJK = HAN + KANA + HANGUL
WIDE_CJK = CJK + r"\x{2E80}-\x{2EFF}\x{2F00}-\x{2FDF}\x{31C0}-\x{31EF}\x{2A6E0}-\x{2EBEF}\x{2F800}-\x{2FA1F}"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
HEBREW = r"\x{0590}-\x{05FF}"
GREEK = r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"
CYRILLIC = r"\x{0400}-\x{052F}"
LATIN = r"A-Za-z\x{C0}-\x{24F}"
SKIPPED = r"\x{00}-@\[-`{-\x{7F}\x{1F300}-\x{1F9FF}"
TOKEN_CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}"

#: Whole-line script tests of the detect command.
DETECT = {"CJK": WIDE_CJK, "CYRILLIC": CYRILLIC, "LATIN": LATIN, "ARABIC": ARABIC, "HEBREW": HEBREW, "GREEK": GREEK}

#: Language codes by the script test that stands for them.
TESTS = {
    "chinese": "ZH ZH-CN ZH-TW HANS HANT".split(),
    "japanese": ["JA"],
    "korean": ["KO"],
    "latin": "EN EN-US EN-GB".split(),
    "arabic": ["AR"],
    "cyrillic": "RU UK BG".split(),
}
SAMPLE_NAMES = {
    "chinese": "ZH ZH-CN ZH-TW HANS HANT CHINESE".split(),
    "japanese": "JA JAPANESE".split(),
    "korean": "KO KOREAN".split(),
    "arabic": "AR ARABIC".split(),
    "cyrillic": "RU RUSSIAN".split(),
    "greek": "EL GREEK".split(),
    "hebrew": "HE HEBREW".split(),
}
SCRIPT_OF = {
    "Cjk": "ZH JA KO HANS HANT ZH-CN ZH-TW".split(),
    "Arabic": ["AR"],
    "Hebrew": ["HE"],
    "Greek": ["EL"],
    "Cyrillic": "RU UK BG SR BE".split(),
    "Latin": "EN DE FR ES IT PT NL SV PL TR CS RO HU DA NO EN-US EN-GB".split(),
}
LATIN_LANGS = "EN DE FR ES IT PT NL SV PL TR CS RO HU DA NO".split()
CLASS = {"chinese": HAN, "japanese": KANA, "korean": HANGUL, "arabic": ARABIC, "cyrillic": CYRILLIC, "greek": GREEK, "hebrew": HEBREW, "cjk": CJK}

SAMPLE = 128


def has(c: Column, ranges: str) -> Column:
    return c.rlike(f"[{ranges}]")


def sample(c: Column, n: int = SAMPLE) -> Column:
    """First n characters that are no white space."""
    return F.substring(F.regexp_replace(c, f"[{WS}]+", ""), 1, n)


def quick_has(c: Column, name: str, n: int = SAMPLE) -> Column:
    """Does the sample hold a character of the script? name: a key of CLASS."""
    return has(sample(c, n), CLASS[name])


def is_latin(c: Column, n: int = SAMPLE) -> Column:
    """More than 70 % of the sample's characters that count are Latin; false without any."""
    s = sample(c, n)
    latin = F.regexp_count(s, F.lit(f"[{LATIN}]"))
    rest = F.length(s) - F.regexp_count(s, F.lit(f"[{SKIPPED}]"))
    return F.coalesce(latin / F.when(rest > 0, rest) > 0.7, F.when(c.isNotNull(), F.lit(False)))


def _first_script(s: Column) -> Column:
    return (
        F.when(has(s, CJK), "Cjk").when(has(s, ARABIC), "Arabic").when(has(s, HEBREW), "Hebrew").when(has(s, GREEK), "Greek")
        .when(has(s, CYRILLIC), "Cyrillic").when(has(s, LATIN), "Latin").when(s.isNotNull(), "Unknown")
    )


def quick_script(c: Column) -> Column:
    return _first_script(sample(c))


def spots(c: Column, rate: int = 100, most: int = 10) -> Column:
    """The characters 1, rate + 1, ... of a text, most of them at most, as an array."""
    last = F.least(F.length(c), F.lit(rate * (most - 1) + 1))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), last, F.lit(rate)), lambda i: F.substring(c, i, F.lit(1)))).when(c.isNotNull(), F.array().cast("array<string>"))


def sampled_script(c: Column) -> Column:
    """quick_script() up to 32 characters; else the script of the first spot that has one."""
    found = F.filter(F.transform(spots(c), _first_script), lambda x: x != "Unknown")
    return F.when(F.length(c) <= 32, quick_script(c)).otherwise(F.coalesce(F.get(found, F.lit(0)), F.when(c.isNotNull(), F.lit("Unknown"))))


def meaningful(c: Column) -> Column:
    """Is any spot neither white space nor skipped?"""
    return F.exists(spots(c), lambda x: ~x.rlike(f"[{SKIPPED}{WS}]"))


def only_symbols(c: Column) -> Column:
    """No character of any supported script."""
    return ~has(c, r"\x{4E00}-\x{9FFF}" + KANA + r"\x{AC00}-\x{D7AF}\x{0600}-\x{06FF}" + HEBREW + r"\x{0370}-\x{03FF}\x{0400}-\x{04FF}" + LATIN)


def cjk_langs(c: Column, allowed: list[str] | None = None) -> Column:
    """Languages by CJK script: kana JA, Hangul KO, Han without kana ZH."""
    may = lambda k: F.lit(allowed is None or k in allowed)
    kana = has(c, KANA) & may("JA")
    return F.array_compact(F.array(
        F.when(kana, "JA"), F.when(has(c, HANGUL) & may("KO"), "KO"), F.when(has(c, UNIFIED) & may("ZH") & ~kana, "ZH")
    ))


def cyrillic_langs(c: Column, allowed: list[str] | None = None) -> Column:
    """Languages by letters of their own, else RU."""
    may = lambda k: F.lit(allowed is None or k in allowed)
    own = F.array_compact(F.array(
        F.when(has(c, "ҐґЄєЇї") & may("UK"), "UK"), F.when(has(c, "Ўў") & may("BE"), "BE"), F.when(has(c, "Ъъ") & may("BG"), "BG")
    ))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(F.when(may("RU"), "RU"))))


def latin_langs(allowed: list[str] | None = None) -> Column:
    """The Latin languages, those allowed: array_intersect with the fixed list."""
    every = F.array(*map(F.lit, LATIN_LANGS))
    return every if allowed is None else F.array_intersect(every, F.array(*map(F.lit, allowed)).cast("array<string>"))


def confidence(c: Column, langs: Column) -> Column:
    """Half by length (100 characters are full), half by the number of languages."""
    n = F.length(F.regexp_replace(c, f"[{WS}]+", ""))
    k = F.size(langs)
    return F.when((n > 0) & (k > 0), F.least(F.least(n / 100.0, F.lit(1.0)) * 0.5 + (F.lit(1.0) / F.when(k > 0, k)) * 0.5, F.lit(1.0))).when(c.isNotNull(), F.lit(0.0))


_GROUPS = {"CJK": ["ZH", "JA", "KO"], "LATIN": LATIN_LANGS, "CYRILLIC": ["RU", "UK", "BE", "BG", "SR"], "ARABIC": ["AR"], "HEBREW": ["HE"], "GREEK": ["EL"]}


def allowed_langs(names: list[str]) -> list[str]:
    """Language codes of codes and group names (CJK, Latin, ...), without repeats."""
    return list(dict.fromkeys(k for n in names for k in _GROUPS.get(n.upper(), [n.upper()])))


def detect(c: Column, allowed: list[str] | None = None, scripts: list[str] | None = None) -> Column:
    """struct<script, langs, has_chars, confidence>: the first allowed script found."""
    may = lambda s: F.lit(scripts is None or s in scripts)
    one = lambda k: F.array(F.lit(k))
    none = F.array().cast("array<string>")
    cjk, cyr, lat = cjk_langs(c, allowed), cyrillic_langs(c, allowed), latin_langs(allowed)

    def info(script: str, langs: Column, chars: bool, conf: Column) -> Column:
        return F.struct(F.lit(script).alias("script"), langs.alias("langs"), F.lit(chars).alias("has_chars"), conf.alias("confidence"))

    return (
        F.when(c.isNull(), F.lit(None))
        .when(only_symbols(c), info("Unknown", none, False, F.lit(0.0)))
        .when(may("Cjk") & (F.size(cjk) > 0), info("Cjk", cjk, True, confidence(c, cjk)))
        .when(may("Arabic") & has(c, r"\x{0600}-\x{06FF}"), info("Arabic", one("AR"), True, F.lit(1.0)))
        .when(may("Hebrew") & has(c, HEBREW), info("Hebrew", one("HE"), True, F.lit(1.0)))
        .when(may("Greek") & has(c, GREEK), info("Greek", one("EL"), True, F.lit(1.0)))
        .when(may("Cyrillic") & has(c, CYRILLIC), info("Cyrillic", cyr, True, confidence(c, cyr)))
        .when(may("Latin") & has(c, LATIN), info("Latin", lat, True, confidence(c, lat)))
        .otherwise(info("Unknown", none, False, F.lit(0.0)))
    )


def primary(info: Column) -> Column:
    return F.get(info["langs"], F.lit(0))


def contains_lang(info: Column, lang: str) -> Column:
    return F.exists(info["langs"], lambda x: F.upper(x) == lang.upper())


def script_of(code: Column) -> Column:
    """Script of a language code in any case; null for an unknown code. Regional English is Latin."""
    k = F.upper(code)
    return reduce(lambda a, s: a.when(k.isin(SCRIPT_OF[s]), s), SCRIPT_OF, F.when(F.lit(False), F.lit("")))


def script_of_code(code: str) -> str | None:
    return next((s for s, codes in SCRIPT_OF.items() if code.upper() in codes), None)


def detector_should_translate(c: Column, source_langs: list[str], target: str) -> Column:
    """Does the detected language ask for translation? "AUTO" is case-sensitive here."""
    i = detect(c)
    chars = i["has_chars"]
    if target in ("", "AUTO"):
        return chars
    goal = script_of_code(target) or "Unknown"
    other = (i["script"] != goal) | ~contains_lang(i, target)
    if not source_langs:
        return chars & other
    tests = []
    for s in source_langs:
        if s == "AUTO":
            tests.append((i["script"] != goal) | ((F.size(i["langs"]) > 0) & ~contains_lang(i, target)))
        else:
            tests.append(contains_lang(i, s))
            if script_of_code(s):
                tests.append(i["script"] == script_of_code(s))
    return chars & reduce(lambda a, b: a | b, tests)


def matches_script(c: Column, name: str) -> Column:
    """Whole-line test of the detect command; an unknown name matches nothing."""
    ranges = DETECT.get(name.upper())
    return has(c, ranges) if ranges else F.when(c.isNotNull(), F.lit(False))


def by_language(c: Column, langs: list[str], names: dict[str, list[str]] = TESTS) -> Column:
    """Does the sample hold the script of any of the languages? An unknown code always does."""
    def test(lang: str) -> Column:
        name = next((k for k, v in names.items() if lang.upper() in v), None)
        if name is None:
            return F.when(c.isNotNull(), F.lit(True))
        return is_latin(c) if name == "latin" else quick_has(c, name)

    return reduce(lambda a, b: a | b, map(test, langs), F.when(c.isNotNull(), F.lit(False)))


def contains_target(c: Column, langs: list[str]) -> Column:
    """by_language() of a whole text of up to 256 characters, else of its beginning, middle
    and end of 128 characters. No languages: true."""
    if not langs:
        return F.when(c.isNotNull(), F.lit(True))
    n = F.length(c)
    parts = [F.substring(c, 1, 128), F.substring(c, F.floor((n - 256) / 2).cast("int") + 1, F.lit(128)), F.substring(c, n - 127, F.lit(128))]
    return F.when(n <= 256, by_language(c, langs, SAMPLE_NAMES)).otherwise(reduce(lambda a, b: a | b, (by_language(p, langs, SAMPLE_NAMES) for p in parts)))
