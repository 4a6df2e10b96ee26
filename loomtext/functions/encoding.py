"""Encodings of binary contents: detection by a cascade, conversion, byte order marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of encodings by their spellings.
NAMES = {"UTF-8": ["UTF-8", "UTF8"], "UTF-16LE": ["UTF-16LE", "UTF16LE"], "UTF-16BE": ["UTF-16BE", "UTF16BE"], "GBK": ["GBK"], "Big5": ["BIG5"], "Shift_JIS": ["SHIFT_JIS", "SHIFTJIS"], "GB18030": ["GB18030"]}
CANDIDATES = ("GBK", "Big5", "Shift_JIS")
MIN_CONFIDENCE = 0.7

#: Ranges of lead and trail bytes.
BYTES = {
    "GBK": ([(0x81, 0xFE)], [(0x40, 0x7E), (0x80, 0xFE)]),
    "GB18030": ([(0x81, 0xFE)], [(0x40, 0x7E), (0x80, 0xFE)]),
    "Big5": ([(0x81, 0xFE)], [(0x40, 0x7E), (0xA1, 0xFE)]),
    "Shift_JIS": ([(0x81, 0x9F), (0xE0, 0xEF)], [(0x40, 0x7E), (0x80, 0xFC)]),
}


def canonical(name: Column) -> Column:
    """Usual name of an encoding; null for one that isn't known."""
    u = F.upper(name)
    out = F.when(F.lit(False), F.lit(""))
    for k, v in NAMES.items():
        out = out.when(u.isin(v), k)
    return out


def bom(content: Column) -> Column:
    """Encoding by the byte order mark; null without one."""
    h = F.hex(F.substring(content, 1, 3))
    return F.when(h == "EFBBBF", "UTF-8").when(h.startswith("FFFE"), "UTF-16LE").when(h.startswith("FEFF"), "UTF-16BE")


def is_ascii(content: Column) -> Column:
    return ~F.hex(content).rlike(r"\A(?:..)*?[89A-F].(?:..)*\z")


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def without_bom(content: Column) -> Column:
    """Without the mark of UTF-8, UTF-32 or UTF-16."""
    h = F.hex(F.substring(content, 1, 4))
    n = F.when(h.startswith("EFBBBF"), 3).when(h.isin("FFFE0000", "0000FEFF"), 4).when(h.startswith("FFFE") | h.startswith("FEFF"), 2).otherwise(0)
    return F.substring(content, n + 1, F.octet_length(content))


def double_byte_score(data: bytes, name: str) -> float | None:
    """Share of well-formed pairs, weighed by how dense they are; None below a half or without
    lead bytes. A lead byte without its trail counts against."""
    lead, trail = BYTES[name]
    good = total = i = 0
    while i < len(data):
        if any(a <= data[i] <= b for a, b in lead):
            total += 1
            if i + 1 < len(data) and any(a <= data[i + 1] <= b for a, b in trail):
                good += 1
                i += 2
                continue
        i += 1
    if not total or good / total < 0.5:
        return None
    return min(1.0, good / total * (0.5 + 0.5 * total * 2 / len(data)))


def guess(data: bytes | None, names: tuple[str, ...] = CANDIDATES) -> tuple[str, float] | None:
    """Best of the scored encodings, of equal ones the first; UTF-8 at 0.3 if none scores."""
    if data is None:
        return None
    scored = [(n, s) for n in names if (s := double_byte_score(data, n)) is not None]
    return max(scored, key=lambda x: x[1]) if scored else ("UTF-8", 0.3)


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def heuristic(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([guess(x) or (None, None) for x in content], columns=["encoding", "confidence"])


def detect(content: Column) -> Column:
    """struct<encoding, confidence>: empty, marked and ASCII contents 1.0, valid UTF-8 0.9, then by
    scores. Only contents that reach the last step are handed to Python."""
    def sure(name: Column, conf) -> Column:
        return F.struct(name.alias("encoding"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"))

    early = content.isNull() | (F.octet_length(content) == 0) | bom(content).isNotNull() | is_utf8(content)
    scored = heuristic(F.when(~early, content))
    return (
        F.when(content.isNull(), F.lit(None)).when(F.octet_length(content) == 0, sure(F.lit("UTF-8"), 1.0)).when(bom(content).isNotNull(), sure(bom(content), 1.0))
        .when(is_utf8(content), sure(F.lit("UTF-8"), F.when(is_ascii(content), 1.0).otherwise(0.9)))
        .otherwise(scored)
    )


def confident(content: Column, least: float = MIN_CONFIDENCE) -> Column:
    """detect(), with an error where the confidence is too low."""
    d = detect(content)
    return F.when(d["confidence"] < least, F.raise_error(F.lit("encoding confidence too low"))).otherwise(d)


_PYTHON = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "GBK": "gb18030", "GB18030": "gb18030", "Big5": "big5", "Shift_JIS": "cp932"}


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, enc: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or e not in _PYTHON else bytes(c).decode(_PYTHON[e], "replace") for c, e in zip(content, enc)], dtype=object)


def to_text(content: Column, enc: Column, strict: bool = False) -> Column:
    """Text of a content in a known encoding, without its mark. UTF-8 is decoded in the JVM; bytes
    that aren't valid become U+FFFD, or the text null if strict."""
    body = without_bom(content)
    other = _decoded(F.when(enc != "UTF-8", body), enc)
    text = F.when(enc == "UTF-8", F.when(is_utf8(body), body.cast("string")).otherwise(F.lit(None) if strict else F.make_valid_utf8(body.cast("string")))).otherwise(other)
    return F.when(~text.contains("�") | text.isNull(), text) if strict else text


#: Lead bytes of the frequent signs of an encoding (signs, kana, first level of hanzi).
FREQUENT = {"GBK": [(0xA1, 0xA9), (0xB0, 0xD7)], "Big5": [(0xA1, 0xC6)], "Shift_JIS": [(0x81, 0x84), (0x88, 0x97)]}


def fitting(data: bytes | None) -> tuple[str, str] | None:
    """(encoding, text) of bytes that are no valid UTF-8: the encoding with the greatest share of
    frequent signs among those beyond ASCII, of equal ones the one with the fewest that aren't
    valid, then the first. Unlike guess(), which holds to byte patterns, it tells Japanese from Chinese."""
    if data is None:
        return None
    best = None
    for name in ("UTF-8", *CANDIDATES):
        text = data.decode(_PYTHON[name], "replace")
        n = good = bad = 0
        for c in text:
            if c.isascii():
                continue
            n += 1
            if c == "�":
                bad += 1
            elif name == "UTF-8":
                good += 1
            else:
                b = c.encode(_PYTHON[name], "replace")
                # of two bytes, or letters of other scripts, which GB18030 writes with four
                good += any(x <= b[0] <= y for x, y in FREQUENT[name]) if len(b) == 2 else len(b) == 4 and c.isalpha()
        key = (good / max(1, n), -bad)
        if best is None or key > best[0]:
            best = (key, name, text)
    return best[1], best[2]


@F.pandas_udf(T.StringType())
def _fitted(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else fitting(bytes(c))[1] for c in content], dtype=object)


def any_text(content: Column) -> Column:
    """Text of every content, without its mark: by the mark, as UTF-8 where that is valid, else in
    the encoding that fits best. Bytes that aren't valid become U+FFFD; null only for null. Only
    contents that are no UTF-8 are handed to Python."""
    mark, valid = bom(content), is_utf8(content)
    enc = F.when(mark.isNotNull() & ~valid, mark).otherwise(F.lit("UTF-8"))
    return F.when(valid | mark.isNotNull(), to_text(content, enc)).otherwise(_fitted(F.when(~valid & mark.isNull(), content)))


@F.pandas_udf(T.BinaryType())
def from_text(text: pd.Series, enc: pd.Series) -> pd.Series:
    """Bytes of a text in an encoding; characters it lacks become question marks."""
    return pd.Series([None if t is None or e not in _PYTHON else t.encode(_PYTHON[e], "replace") for t, e in zip(text, enc)], dtype=object)
