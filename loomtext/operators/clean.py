"""Comments and literals without their marks, as Columns; unescaping as a pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.scalars import trim_space
from loomtext.functions.scripts import WS


def _start(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+", "")


def _end(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+\z", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end makes no empty line."""
    parts = F.split(F.regexp_replace(c, r"\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _unstarred(c: Column) -> Column:
    """Each line without leading blanks, one star and the blanks after it; the end trimmed."""
    line = F.transform(lines(c), lambda x: F.regexp_replace(x, rf"\A[{WS}]*(?:\*[{WS}]*)?", ""))
    return _end(F.array_join(line, "\n"))


def line_comment(c: Column) -> Column:
    return F.regexp_replace(trim_space(c), rf"\A(?:#|//)[{WS}]*", "")


def block_comment(c: Column) -> Column:
    """/* and */ taken off and the stars of the lines; what follows the first */ is dropped."""
    t = _start(c)
    inner = F.when(t.startswith("/*"), F.substring_index(F.substring(t, 3, 1 << 30), "*/", 1)).otherwise(t)
    return _unstarred(trim_space(inner))


def doc_comment(c: Column) -> Column:
    """///- and //!-comments keep only the lines so marked; blocks and bare texts lose their stars."""
    t = F.regexp_replace(_start(c), rf"(?:(?!\n)[{WS}])+\z", "")

    def marked(mark: str) -> Column:
        own = F.filter(F.transform(lines(t), _start), lambda x: x.startswith(mark))
        return F.array_join(F.transform(own, lambda x: _start(F.substring(x, len(mark) + 1, 1 << 30))), "\n")

    inner = F.substring_index(F.substring(t, 4, 1 << 30), "*/", 1)
    return (
        F.when(t.startswith("///"), marked("///")).when(t.startswith("//!"), marked("//!"))
        .when(t.startswith("/**"), _unstarred(inner)).when(t.startswith("/*"), block_comment(t)).otherwise(_unstarred(t))
    )


def comment(c: Column, kind: Column) -> Column:
    """kind: line, block or doc."""
    return F.when(kind == "line", line_comment(c)).when(kind == "block", block_comment(c)).when(kind == "doc", doc_comment(c))


def raw_string(c: Column) -> Column:
    """r"..." and r#"..."# without prefix, hashes and quotes."""
    body = F.regexp_replace(c, r'\Ar#*"?', "")
    hashes = F.regexp_extract(c, r"\Ar(#*)", 1)
    tail = F.concat(F.lit('"'), hashes)
    return F.when(body.endswith(tail), F.substring(body, F.lit(1), F.length(body) - F.length(tail))).otherwise(body)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "0": "\0"}


def unescape_text(t: str | None) -> str | None:
    """Usual escapes; an unknown one stays as it is."""
    if t is None or "\\" not in t:
        return t
    out, i = [], 0
    while i < len(t):
        if t[i] == "\\" and i + 1 < len(t):
            out.append(_ESCAPES.get(t[i + 1], t[i : i + 2]))
            i += 2
        else:
            out.append(t[i])
            i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def unescape(c: pd.Series) -> pd.Series:
    return c.map(unescape_text, na_action="ignore").astype(object)


def string_body(c: Column) -> Column:
    """A literal without quotes and prefix, still escaped."""
    def cut(k: int) -> Column:
        return F.substring(c, F.lit(k + 1), F.greatest(F.length(c) - k - 1, F.lit(0)))

    return (
        F.when(c.startswith("`") & c.endswith("`") & (F.length(c) > 1), cut(1))
        .when(c.startswith("r") & (F.length(c) > 1), raw_string(c))
        .when(c.startswith('b"') | c.startswith('f"'), cut(2))
        .when(c.startswith("'") & c.endswith("'") & (F.length(c) > 1), cut(1))
        .otherwise(F.regexp_replace(c, r'\A"+|"+\z', ""))
    )


def string_literal(c: Column) -> Column:
    """string_body() with its escapes undone, but for raw strings and backticks."""
    raw = (c.startswith("`") & c.endswith("`")) | (c.startswith("r") & (F.length(c) > 1))
    return F.when(raw, string_body(c)).otherwise(unescape(string_body(c)))


def brackets(c: Column, kind: str) -> Column:
    """Without the round, square or curly brackets around a text; other kinds leave it."""
    pair = {"round": "()", "square": "[]", "curly": "{}"}.get(kind)
    if pair is None:
        return c
    t = trim_space(c)
    return F.when(t.startswith(pair[0]) & t.endswith(pair[1]) & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def quotes(c: Column) -> Column:
    t = trim_space(c)
    both = ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'"))) & (F.length(t) > 1)
    return F.when(both, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def extract(c: Column, rule: dict) -> Column:
    """An extraction rule: none, remove_quotes, regex(pattern, group), remove_comment_markers
    (comment_type) or remove_brackets(bracket_type). What a rule doesn't fit stays as it is."""
    kind = rule.get("type", "none")
    if kind == "remove_quotes":
        return quotes(c)
    if kind == "regex":
        p, g = rule["pattern"], int(rule.get("group", 0))
        return F.when(c.rlike(p), F.coalesce(F.nullif(F.regexp_extract(c, p, g), F.lit("")), c)).otherwise(c)
    if kind == "remove_comment_markers":
        return {"line": line_comment, "block": block_comment, "doc": doc_comment}.get(rule.get("comment_type"), lambda x: x)(c)
    if kind == "remove_brackets":
        return brackets(c, rule.get("bracket_type", ""))
    return c
