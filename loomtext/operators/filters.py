"""Filters that choose the texts to translate, as boolean Columns.

Each returns false for a null text. Lengths are UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import scripts as S

#: A filter: any callable from the text column to a boolean column.
Filter = Callable[[Column], Column]

# Patterns of the default filters. (?U) makes \w, \d and \b Unicode-aware in Java.
URL = r"https?://[^\s]+|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PLACEHOLDERS = [r"%[sdvf]", r"\$\d{1,2}\b", r"\$\{[^}]*\}", r"\{[a-zA-Z_][a-zA-Z0-9_]*\}"]
ANY_BRACES = [r"%[sdvf]", r"\$\d{1,2}\b", r"\$\{[^}]*\}", r"\{[^}]*\}"]
CODE = [r"\w+\([^)]*\)", r"\w+\[[^\]]*\]", r"`[^`]+`"]
KEYWORDS = ["License", "Licensed", "Copyright", "Author", "TODO", "NOTE"]

# Letters of writing systems, and symbols that are none.
LETTERS = (
    r"A-Za-z\x{C0}-\x{24F}\x{370}-\x{3FF}\x{1F00}-\x{1FFF}\x{400}-\x{52F}\x{590}-\x{5FF}\x{600}-\x{6FF}\x{750}-\x{77F}\x{900}-\x{97F}\x{E00}-\x{E7F}"
    r"\x{3040}-\x{318F}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}"
)
SPECIAL = (
    r"!-/:-@\[-`{-~\x{A0}-\x{BF}\x{2B0}-\x{36F}\x{20A0}-\x{20CF}\x{2100}-\x{243F}\x{2500}-\x{27FF}\x{2A00}-\x{2BFF}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
    r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
)
PUNCTUATION = r"!-/:-@\[-`{-~"


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike("(?U)" + p) for p in patterns), F.lit(False))


def _sure(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


@dataclass
class FilterConfig:
    """Options of the composite filter; empty lists take the defaults. Lengths of 0 are off."""

    min_length: int = 2
    max_length: int = 100_000
    exclude_keywords: list[str] = field(default_factory=lambda: list(KEYWORDS))
    exclude_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)
    placeholder_patterns: list[str] = field(default_factory=list)
    code_patterns: list[str] = field(default_factory=list)
    allow_placeholders: bool = False
    detect_code_patterns: bool = True
    language_only: list[str] = field(default_factory=list)

    def validate(self) -> "FilterConfig":
        """ValueError for a pattern that doesn't compile."""
        for p in [*self.exclude_patterns, *self.include_patterns, *self.placeholder_patterns, *self.code_patterns]:
            try:
                re.compile(p)
            except re.error as x:
                raise ValueError(f"invalid pattern {p!r}: {x}") from None
        return self


def length_filter(c: Column, least: int = 0, most: int = 0) -> Column:
    n = F.octet_length(c)
    ok = c.rlike(f"[^{S.WS}]")
    if least > 0:
        ok = ok & (n >= least)
    if most > 0:
        ok = ok & (n <= most)
    return _sure(ok)


def only_symbols(c: Column) -> Column:
    return c.rlike(rf"\A[{S.WS}{PUNCTUATION}]*\z")


def only_digits_and_symbols(c: Column) -> Column:
    return c.rlike(rf"\A[{S.WS}{PUNCTUATION}0-9]*\z")


def only_digits(c: Column) -> Column:
    return c.rlike(rf"\A[{S.WS}0-9]*\z")


def is_letter(c: Column) -> Column:
    """Does a text hold a letter that is no special character?"""
    return c.rlike(rf"[{LETTERS}&&[^{SPECIAL}]]")


def is_special(c: Column) -> Column:
    return c.rlike(f"[{SPECIAL}]")


def content_filter(c: Column) -> Column:
    """Something to translate: not only symbols and digits, and a letter."""
    return _sure(~only_digits_and_symbols(c) & is_letter(c))


def contains_placeholder(c: Column, patterns: list[str] | None = None) -> Column:
    return _any(c, patterns or PLACEHOLDERS)


def contains_code(c: Column, patterns: list[str] | None = None) -> Column:
    return _any(c, patterns or CODE)


def keyword_pattern(words: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def pattern_filter(c: Column, cfg: FilterConfig | None = None, check_code: bool = True) -> Column:
    cfg = cfg or FilterConfig()
    bad = c.rlike(URL)
    if not cfg.allow_placeholders:
        bad = bad | contains_placeholder(c, cfg.placeholder_patterns)
    if cfg.exclude_keywords:
        bad = bad | c.rlike("(?U)" + keyword_pattern(cfg.exclude_keywords))
    if cfg.exclude_patterns:
        bad = bad | _any(c, cfg.exclude_patterns)
    if cfg.include_patterns:
        bad = bad | ~_any(c, cfg.include_patterns)
    if cfg.detect_code_patterns and check_code:
        bad = bad | contains_code(c, cfg.code_patterns)
    return _sure(~bad)


def is_target_language(c: Column, target: str) -> Column:
    t = target.upper()
    if t in S.TESTS["latin"]:
        return S.is_latin(c) & ~S.quick_has(c, "cjk")
    for name, codes in (("chinese", ["ZH", "ZH-CN", "ZH-TW"]), ("japanese", ["JA"]), ("korean", ["KO"])):
        if t in codes:
            return S.quick_has(c, name) & ~S.is_latin(c)
    return F.when(c.isNotNull(), F.lit(False))


def translatable(c: Column) -> Column:
    """Any alphabetic character or one of the listed scripts."""
    return c.rlike(r"[\p{IsAlphabetic}" + S.CJK + S.ARABIC + S.CYRILLIC + S.HEBREW + S.GREEK + "]")


def contains_source(c: Column, source_langs: list[str], target: str) -> Column:
    if not source_langs:
        return F.when(c.isNotNull(), F.lit(True))
    if any(x.upper() == "AUTO" for x in source_langs):
        return ~is_target_language(c, target) & translatable(c)
    return S.by_language(c, source_langs)


def language_filter(c: Column, source_langs: list[str], target: str) -> Column:
    """Translatable, and not yet in the target language (no sources) or in a source language."""
    if not source_langs:
        return _sure(translatable(c) & ~is_target_language(c, target))
    return _sure(translatable(c) & contains_source(c, source_langs, target))


def protected(c: Column, urls: bool = True, placeholders: bool = True, allow: bool = False) -> Column:
    """Must a text be left alone for its addresses or placeholders?"""
    bad = F.lit(False)
    if urls:
        bad = bad | c.rlike(URL)
    if placeholders and not allow:
        bad = bad | _any(c, ANY_BRACES)
    return bad


def language_only_filter(c: Column, langs: list[str], urls: bool = True, placeholders: bool = True, allow: bool = False) -> Column:
    if not langs:
        return F.lit(False)
    return _sure(S.by_language(c, langs) & ~protected(c, urls, placeholders, allow))


def composite(c: Column, cfg: FilterConfig | None = None, source_langs: list[str] | None = None, target: str = "EN", check_code: bool = True) -> Column:
    """language_only alone if it is set, else length, language, pattern and content together.
    The cheap tests stand first: Catalyst keeps their order and stops at the first false."""
    cfg = cfg or FilterConfig()
    if cfg.language_only:
        return language_only_filter(c, cfg.language_only)
    return (
        length_filter(c, cfg.min_length, cfg.max_length)
        & language_filter(c, source_langs or [], target)
        & pattern_filter(c, cfg, check_code)
        & content_filter(c)
    )


def reason(c: Column, cfg: FilterConfig | None = None, source_langs: list[str] | None = None, target: str = "EN") -> Column:
    """Name of the first filter that rejects a text; kept if none does."""
    cfg = cfg or FilterConfig()
    return (
        F.when(~length_filter(c, cfg.min_length, cfg.max_length), "length")
        .when(~language_filter(c, source_langs or [], target), "language")
        .when(~pattern_filter(c, cfg), "pattern")
        .when(~content_filter(c), "content")
        .otherwise("kept")
    )


def default_filter() -> tuple[FilterConfig, list[str], str]:
    return FilterConfig(), [], "EN"


def verify_filter() -> tuple[FilterConfig, list[str], str]:
    """Permissive: nothing but blank texts, targets no language, no code check."""
    return FilterConfig(min_length=1, max_length=0, exclude_keywords=[], allow_placeholders=True, detect_code_patterns=False), [], "XX"


def capped_length(project: int, translator: int | None) -> int:
    """The smaller limit; 0 is none; neither: 100,000."""
    both = [x for x in (project, translator) if x]
    return min(both) if both else 100_000


def capped_length_column(project: Column, translator: Column) -> Column:
    return F.coalesce(F.least(F.nullif(project, F.lit(0)), F.nullif(translator, F.lit(0))), F.lit(100_000))


def match_filter(df, pattern_name: str | None = None, ext: str | None = None, category: str | None = None, text: str | None = None):
    """Matches whose pattern name and text hold the given strings and whose extension (any
    case) and category are the given ones; what isn't given doesn't filter."""
    if pattern_name is not None:
        df = df.where(F.col("pattern_name").contains(pattern_name))
    if ext is not None:
        df = df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)) == ext.lower())
    if category is not None:
        df = df.where(F.col("category") == category)
    if text is not None:
        df = df.where(F.col("extracted_text").contains(text))
    return df


#: Categories of functions by exact name, in the order they are looked up.
CATEGORIES = ("error", "format", "log", "debug", "test")


def classify_function(name: Column, patterns: dict[str, list[str]]) -> Column:
    """First category that lists the name; null if none does."""
    return reduce(lambda a, k: a.when(name.isin(patterns.get(k, [])), k), CATEGORIES, F.when(F.lit(False), F.lit("")))


# Names of functions that take texts, by kind and language.
FUNCTIONS = {
    ("error_handling", "javascript"): ("Error", "TypeError", "ReferenceError", "SyntaxError", "RangeError", "URIError", "EvalError", "AggregateError"),
    ("error_handling", "python"): ("Exception", "ValueError", "TypeError", "KeyError", "IndexError", "RuntimeError", "AssertionError", "NotImplementedError"),
    ("error_handling", "rust"): ("panic", "todo", "unimplemented", "unreachable", "assert", "assert_eq", "assert_ne"),
    ("error_handling", "go"): ("errors.New", "fmt.Errorf", "panic"),
    ("error_handling", "java"): ("IllegalArgumentException", "IllegalStateException", "NullPointerException", "RuntimeException", "Exception"),
    ("error_handling", "csharp"): ("ArgumentException", "InvalidOperationException", "NullReferenceException", "Exception"),
    ("output", "javascript"): ("console.log", "console.error", "console.warn", "console.info", "console.debug", "console.trace", "console.dir"),
    ("output", "python"): ("print", "logging.debug", "logging.info", "logging.warning", "logging.error", "logging.critical", "logging.exception"),
    ("output", "rust"): ("println", "eprintln", "print", "eprint", "dbg"),
    ("output", "go"): ("fmt.Println", "fmt.Printf", "fmt.Print", "fmt.Fprintf", "fmt.Fprintln", "log.Println", "log.Printf", "log.Print"),
    ("output", "java"): ("System.out.println", "System.out.print", "System.err.println", "System.err.print", "Logger.getLogger"),
    ("output", "csharp"): ("Console.WriteLine", "Console.Write", "Console.Error.WriteLine", "Console.Error.Write", "Debug.WriteLine"),
}
VARIABLES = [".*Message$", ".*Text$", ".*Title$", ".*Label$", ".*Hint$", ".*Placeholder$"]
PROPERTIES = ["message", "title", "description", "text", "content", "label", "placeholder", "tooltip", "hint"]
_SAME = {"typescript": "javascript", "jsx": "javascript", "tsx": "javascript"}


def default_patterns(lang: str, category: str) -> list[str]:
    """Names by language and category; variable and property names for any language."""
    if category in ("variable", "property"):
        return VARIABLES if category == "variable" else PROPERTIES
    return list(FUNCTIONS.get((category, _SAME.get(lang, lang)), ()))
