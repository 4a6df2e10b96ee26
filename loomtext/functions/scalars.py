"""Scalar functions over strings, numbers, dates, arrays, maps, JSON and hashes, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.scripts import TOKEN_CJK, WS

# -- sizes and limits -------------------------------------------------------------------

#: Characters per token (CJK, others), share kept for the output, tokens of the prompt.
TOKENS = {"default": (1.5, 4.0, 0.4, 150), "conservative": (1.5, 3.5, 0.5, 180)}

#: Requests per second, characters at most, characters of a split piece.
PROVIDER_LIMITS = {"deeplx": (10, 5000, 4000), "tencent": (20, 6000, 5000)}


def estimate_tokens(c: Column, kind: str = "default") -> Column:
    cjk, other, _, prompt = TOKENS[kind]
    n = F.regexp_count(c, F.lit(f"[{TOKEN_CJK}]"))
    return (F.ceil(n / cjk + (F.length(c) - n) / other) + prompt).cast("long")


def max_chars(tokens: Column, kind: str = "default") -> Column:
    """Characters of input for a token limit; the CJK ratio, to be safe."""
    cjk, _, reserve, prompt = TOKENS[kind]
    room = F.floor(tokens.cast("double") * (1.0 - reserve)) - prompt
    return F.floor(F.greatest(room, F.lit(0)) * cjk).cast("long")


def chars_to_tokens(n: Column) -> Column:
    return F.ceil(n / 1.5).cast("long")


def tokens_to_chars(n: Column) -> Column:
    return F.floor(n * 1.5).cast("long")


def split_limit(n: Column) -> Column:
    """Length of a split piece for a limit of characters: four fifths, rounded down."""
    return F.floor(n * 4 / 5).cast("long")


def input_limit(max_tokens: Column) -> Column:
    return F.when(max_tokens <= 0, F.lit(4000)).otherwise(F.floor(F.floor(max_tokens * 0.7) * 1.5)).cast("long")


def fits(c: Column, cap: Column) -> Column:
    """Byte length within a cap; a cap of 0 has no bound."""
    return (cap == 0) | (F.octet_length(c) <= cap)


def fits_tokens(c: Column, max_tokens: int, kind: str = "default") -> Column:
    return estimate_tokens(c, kind) <= max_tokens


def backoff_ms(attempt: Column) -> Column:
    """Delay before a retry: doubling from 100 ms to 5 s at most, and a tenth more."""
    d = F.least(F.lit(100) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))), F.lit(5000.0))
    return F.floor(d * 1.1 + 1e-9).cast("long")


#: Messages after which a retry is useless.
FINAL = ["invalid api key", "authentication failed", "unauthorized", "forbidden"]


def is_retryable(kind: Column, message: Column) -> Column:
    """Transport errors always; failed translations unless the message says that access is denied."""
    low = F.lower(F.coalesce(message, F.lit("")))
    denied = reduce(lambda a, x: a | low.contains(x), FINAL, F.lit(False))
    return F.when(kind == "http", True).when(kind == "translation", ~denied).otherwise(False)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(100.0 * part / F.when(whole > 0, whole), F.lit(0.0))


# -- texts --------------------------------------------------------------------------------


def split_chars(c: Column, size: int) -> Column:
    """Pieces of so many characters, in order; an empty text gives none."""
    last = F.length(c)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last, F.lit(size)), lambda i: F.substring(c, i, F.lit(size)))).when(c.isNotNull(), F.array().cast("array<string>"))


def shorten(c: Column, most: int) -> Column:
    """Of a longer text the first most - 3 characters and three dots."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(max(0, most - 3))), F.lit("..."))).otherwise(c)


def cut_with_dots(c: Column, most: int) -> Column:
    """Of a longer text the first most characters and three dots."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Extension without dot; empty if there is none."""
    return F.regexp_extract(path, r"\.([^./]+)\z", 1)


def redact(c: Column, keys: tuple[str, ...] = ()) -> Column:
    """Keys and tokens replaced by stars."""
    star = F.lit("***REDACTED***")
    for k in keys:
        if k:
            c = F.replace(c, F.lit(k), star)
    c = F.regexp_replace(c, r"sk-[a-zA-Z0-9]{20,}", "***REDACTED***")
    return F.regexp_replace(c, r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*", "***REDACTED***")


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def unwrap_markdown(c: Column) -> Column:
    """Without a code fence or code span around the whole text."""
    t = trim_space(c)
    fence = r"(?s)\A```(?:\w*)\n?(.*?)\n?```\z"
    span = r"\A`([^`]+)`\z"
    return F.when(t.rlike(fence), trim_space(F.regexp_extract(t, fence, 1))).when(t.rlike(span), F.regexp_extract(t, span, 1)).otherwise(t)


#: Phrases that a translation only holds if the original does.
PHRASES = ["translate", "translation", "here is the translation", "the translation is", "as a translator", "in the target language"]


def translation_issue(original: Column, translated: Column) -> Column:
    """empty, too_long (five times the original), phrase, or null for a valid translation."""
    lo, lt = F.lower(original), F.lower(translated)
    phrase = reduce(lambda a, p: a | (lt.contains(p) & ~lo.contains(p)), PHRASES, F.lit(False))
    n = F.length(original)
    ratio = F.coalesce(F.length(translated) / F.when(n > 0, n), F.lit(1.0))
    return F.when(F.coalesce(F.length(translated), F.lit(0)) == 0, "empty").when(ratio > 5.0, "too_long").when(phrase, "phrase")


def user_prompt(text: Column, source: Column, target: Column, template: str | None = None) -> Column:
    """The prompt of a request; the source AUTO in any case asks for detection and names the target."""
    if template is not None:
        out = F.lit(template)
        for name, c in (("{source_lang}", source), ("{target_lang}", target), ("{text}", text)):
            out = F.replace(out, F.lit(name), c)
        return out
    auto = F.concat(F.lit("Auto-detect the source language and translate to "), target)
    return F.concat(F.when(F.upper(source) == "AUTO", auto).otherwise(F.concat(F.lit("Translate from "), source, F.lit(" to "), target)), F.lit(":\n\n"), text)


#: Instructions to a model.
SYSTEM_PROMPT = "You translate comments and texts of source code. Answer with the translation alone, in the target language. Leave names, code and placeholders as they are, and keep the line breaks of the input."


def request_body(model: str, text: Column, source: Column, target: Column) -> Column:
    """JSON body of a chat request."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user_prompt(text, source, target))).alias("messages")))


def reply_text(body: Column) -> Column:
    """Content of the first choice of a chat reply; null for errors and anything else."""
    return F.get_json_object(body, "$.choices[0].message.content")


def reply_error(body: Column) -> Column:
    return F.get_json_object(body, "$.error.message")


#: Placeholders that are no API keys.
NO_KEYS = (
    "xxx",
    "your-api-key",
    "your_api_key",
    "api-key-here",
    "placeholder",
    "test",
    "example",
    "null",
    "undefined",
    "none",
    "empty",
    "default",
)


def valid_key(c: Column) -> Column:
    return F.coalesce((c != "") & ~(c.startswith("${") & c.endswith("}")) & ~F.lower(c).isin(*NO_KEYS), F.lit(False))


def expand_env(c: Column, env: dict[str, str]) -> Column:
    """${NAME} and $NAME replaced by their values; unknown names stay. Longer names first, so
    that none is taken for the beginning of another."""
    for k in sorted(env, key=lambda x: (-len(x), x)):
        safe = env[k].replace("\\", "\\\\").replace("$", "\\$")
        c = F.regexp_replace(c, r"\$\{" + k + r"\}|\$" + k + r"(?![A-Za-z0-9_])", safe)
    return c


def expand_env_map(c: Column, env: dict[str, str]) -> Column:
    return F.transform_values(c, lambda _, v: expand_env(v, env))


# -- placeholders ------------------------------------------------------------------------

# Format specifiers of three families, and the marks that stand for them.
FORMATS = {
    "printf": (r"%[+-]?\d*(?:\.\d+)?[diouxXeEfFgGaAcspn%]", "__FMT_"),
    "python": (r"\{[^}]*\}", "__PYFMT_"),
    "rust": (r"\{(?:[^{}]|\{[^{}]*\})*\}", "__RUSTFMT_"),
}


def protect(c: Column, family: str) -> Column:
    """struct<text, originals>: specifiers replaced by numbered marks, in order, and what they were."""
    pattern, mark = FORMATS[family]
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.split(c, pattern, -1)
    # text parts and marks take turns
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(mark), (i - 1).cast("string"), F.lit("__"), p))), "")
    return F.struct(text.alias("text"), found.alias("originals"))


def restore(text: Column, originals: Column, family: str) -> Column:
    """The marks replaced by the originals, the last first, so that __10__ is no __1__."""
    mark = FORMATS[family][1]
    numbered = F.reverse(F.transform(originals, lambda x, i: F.struct(i.cast("string").alias("i"), x.alias("x"))))
    return F.aggregate(numbered, text, lambda a, m: F.replace(a, F.concat(F.lit(mark), m["i"], F.lit("__")), m["x"]))


def protect_spans(text: Column, spans: Column) -> Column:
    """text with its spans array<struct<start, end, ...>> (characters, ascending, apart)
    replaced by __PH_i__."""
    numbered = F.reverse(F.transform(spans, lambda s, i: F.struct(s["start"].alias("s"), s["end"].alias("e"), i.cast("string").alias("i"))))
    return F.aggregate(numbered, text, lambda a, m: F.overlay(a, F.concat(F.lit("__PH_"), m["i"], F.lit("__")), m["s"] + 1, m["e"] - m["s"]))


def marker_variants(i: Column) -> Column:
    """Damaged forms of the mark __PH_i__ that a provider may give back."""
    n = i.cast("string")
    return F.array(F.concat(F.lit("__PH_"), n), F.concat(n, F.lit("__")), F.concat(F.lit("__PH"), n, F.lit("__")), F.concat(F.lit("__PH"), n, F.lit("_")))


def restore_spans(text: Column, originals: Column) -> Column:
    """__PH_i__ replaced by the originals; where the exact mark is missing, its first damaged
    form that occurs, with blanks inside allowed."""
    numbered = F.reverse(F.transform(originals, lambda x, i: F.struct(i.alias("i"), x.alias("x"))))

    def one(a, m):
        exact = F.concat(F.lit("__PH_"), m["i"].cast("string"), F.lit("__"))
        spaced = F.concat(F.lit("__ PH_"), m["i"].cast("string"), F.lit(" __"))
        hit = F.get(F.filter(F.concat(F.array(exact, spaced), marker_variants(m["i"])), lambda v: F.contains(a, v)), F.lit(0))
        return F.when(hit.isNull(), a).otherwise(F.replace(a, hit, m["x"]))

    return F.aggregate(numbered, text, one)


def markers(c: Column) -> Column:
    """Numbers of the marks in a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"__PH_(\d+)__"), F.lit(1)), lambda x: x.cast("int"))


def missing_markers(original: Column, translated: Column) -> Column:
    return F.array_except(markers(original), markers(translated))


def unexpected_markers(original: Column, translated: Column) -> Column:
    return F.array_except(markers(translated), markers(original))


def has_braces(c: Column) -> Column:
    return c.contains("{") & c.contains("}")


# -- positions and replacements ----------------------------------------------------------


def line_of(prefix: Column) -> Column:
    """Line of the place after a prefix, from 1."""
    return F.regexp_count(prefix, F.lit("\n")) + 1


def column_of(prefix: Column) -> Column:
    """Column of the place after a prefix in bytes, from 1."""
    return F.octet_length(F.substring_index(prefix, "\n", -1)) + 1


def byte_prefix(text: Column, offset: Column) -> Column:
    """The first offset bytes of a text as a text; null inside a character or beyond the end."""
    raw = F.substring(text.cast("binary"), F.lit(1), offset)
    return F.when((offset <= F.octet_length(text)) & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end as a text; null for a bad range."""
    raw = F.substring(text.cast("binary"), start + 1, end - start)
    return F.when((start >= 0) & (start <= end) & (end <= F.octet_length(text)) & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def byte_to_char(text: Column, offset: Column) -> Column:
    """Characters that start before a byte."""
    return F.coalesce(F.length(byte_prefix(text, offset)), F.length(text))


def within(pos: Column, start: Column, end: Column) -> Column:
    return pos.between(start, end)


def distance(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def line_ending(c: Column) -> Column:
    return F.when(c.contains("\r\n"), "\r\n").otherwise("\n")


def with_line_ending(c: Column, ending: Column) -> Column:
    lf = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.when(ending == "\r\n", F.replace(lf, F.lit("\n"), F.lit("\r\n"))).otherwise(lf)


def apply_regions(text: Column, regions: Column) -> Column:
    """text with array<struct<start, end, text>> (characters) replaced, from the right; ranges
    outside of the text are skipped."""
    ordered = F.reverse(F.array_sort(F.transform(regions, lambda r: F.struct(r["start"].alias("s"), r["end"].alias("e"), r["text"].alias("t")))))
    good = F.filter(ordered, lambda r: (r["s"] >= 0) & (r["s"] <= r["e"]) & (r["e"] <= F.length(text)))
    return F.aggregate(good, text, lambda a, r: F.concat(F.substring(a, F.lit(1), r["s"]), r["t"], F.substring(a, r["e"] + 1, F.length(a))))


def unified_diff(changes: Column) -> Column:
    """Text of array<struct<start, old, new>>: three lines for each change, in order."""
    line = F.transform(F.array_sort(changes), lambda x: F.concat(F.lit("@@ "), x["start"].cast("string"), F.lit(" @@\n-"), x["old"], F.lit("\n+"), x["new"]))
    return F.array_join(line, "\n")


def comment_prefix(line: Column) -> Column:
    """Indent and mark of a comment line, with one blank; the indent alone without a mark."""
    indent = F.regexp_extract(line, rf"\A([{WS}]*)", 1)
    mark = F.regexp_extract(line, rf"\A[{WS}]*(///|//!|//|/\*\*|/\*|\*|#)", 1)
    return F.when(mark != "", F.concat(indent, mark, F.lit(" "))).otherwise(indent)


#: Kinds of comment marks.
PREFIX_KINDS = {"///": "doc", "//!": "module_doc", "//": "line", "/**": "block_doc", "/*": "block", "*": "star", "#": "hash", "": "none"}


def comment_kind(line: Column) -> Column:
    mark = F.regexp_extract(line, rf"\A[{WS}]*(///|//!|//|/\*\*|/\*|\*|#)", 1)
    return F.create_map(*[F.lit(x) for kv in PREFIX_KINDS.items() for x in kv])[mark]


# -- hashes and dates ------------------------------------------------------------------------


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(16))


def project_fingerprint(path: Column, created: Column) -> Column:
    return short_hash(F.concat_ws("|", path, created.cast("string")))


def project_id(path: Column) -> Column:
    return short_hash(path)


def config_hash(cfg: dict) -> Column:
    """Short hash of a configuration: every list and switch with its tag, so that no two
    configurations that extract differently share it."""
    def show(v) -> str:
        return "".join(f"{x}," for x in v) if isinstance(v, (list, tuple)) else str(int(v)) if isinstance(v, bool) else str(v)

    return short_hash(F.lit("|".join(f"{k}:{show(v)}" for k, v in cfg.items())))


def crc32(c: Column) -> Column:
    return F.crc32(c)


def utc_date(seconds: Column) -> Column:
    """yyyy-MM-dd in UTC of epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def next_key(n: Column, keys: list[str]) -> Column:
    """Keys in turn."""
    return F.element_at(F.array(*map(F.lit, keys)), F.pmod(n, F.lit(len(keys))).cast("int") + 1)
