"""p3: text decoded with the wrong character encoding.

A best-first graph search: a state is a text, an edge encodes it with one encoding and decodes
the bytes with another, or undoes character escapes. States are kept in a visited set and
expanded in the order of their cost, how implausible their characters are; the cheapest text
reached is the restored one. Edges also apply to a part of a text (a run of characters the
encoding has, and within it the valid UTF-8 sequences), so texts damaged in part are found.

Plausible characters are learned from all labelled text in known languages, counted in the
cluster; only counts of characters reach the driver, bounded by Unicode and not by the tables. A
text is wrongly decoded if the search reaches a clearly cheaper one, or if it carries characters that
only failed decoding leaves behind (replacement characters, C1 controls).
"""

from __future__ import annotations

import functools
import heapq
import html
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Mapping

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.langid import LANGS, label
from loomtext.session import batch_rows, spread, table

#: A state is given up if its cost is above that of the best text, or of the state it comes from, by more than SLACK and
#: SLACK_PER_SIGN for each character above ASCII. There is no other bound, neither of depth nor of states.
SLACK, SLACK_PER_SIGN = 8.0, 0.05

#: Encodings a text may have been decoded with, and those its bytes may really be in.
SINGLE = {
    "cp1252": ("utf-8", "gbk", "cp932", "cp949", "big5", "euc_jp", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437"),
    "cp1251": ("utf-8", "koi8_r", "cp866", "gbk", "cp932", "cp949", "cp1252"),
    "koi8_r": ("utf-8", "cp1251", "cp866", "cp1252"),
    "cp866": ("utf-8", "cp1251", "koi8_r", "cp1252"),
    "mac_roman": ("utf-8", "cp1252"),
    "cp437": ("utf-8", "cp1252"),
    "cp1250": ("utf-8", "cp1252"),
}
_LATIN = {"cp1252", "mac_roman", "cp437", "cp1250"}
MULTI = ("gbk", "cp932", "cp949", "big5", "euc_jp")

_UTF8 = regex.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_ODD_CASE = regex.compile(r"[а-яё][А-ЯЁ]|[à-öø-ÿ][À-ÖØ-Þ]|[A-Za-zÀ-ɏ][Ѐ-ӿͰ-Ͽ⁰-₟√-∾⌀-⏿]|[Ѐ-ӿͰ-Ͽ⁰-₟√-∾⌀-⏿][A-Za-zÀ-ɏ]")
_SIGN = regex.compile(r"[Â-ô][\x80-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")  # UTF-8 read as Windows-1252
_HIGH = regex.compile(r"[^\x00-\x7f]")
#: Signs that right texts use in any language.
_TYPOGRAPHY = "–—‘’‚“”„«»‹›…•·€£¥§©®™°±²³µ¼½¾×÷¡¿ªº←→↑↓✓✗≤≥≈−　、。「」『』（）！？：；，．・〜"
_LOST = regex.compile(r"[\x80-\x9f�]")
#: Marks of ISO-2022-JP read as ASCII, with or without the escape characters, and bytes as quoted-printable has them.
_ISO_2022 = regex.compile(r"(?:\x1b\$[@B]|(?<!\x1b)\$[@B])((?:[!-~]{2})+)(?:\x1b\([BJ]|\([BJ])")
_QUOTED = regex.compile(r"(?:=(?:\r?\n)?[0-9A-F]{2})*(?:=(?:\r?\n)?[89A-F][0-9A-F]){2}(?:=(?:\r?\n)?[0-9A-F]{2})*")
_ESCAPED = regex.compile(_ISO_2022.pattern + "|(?:=[89A-F][0-9A-F]){2}|" + r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d?);|\\u00[89a-fA-F][0-9a-fA-F]|\\x[89a-fA-F][0-9a-fA-F]|(?:%[89a-fA-F][0-9a-fA-F]){2}")


@functools.lru_cache(maxsize=None)
def _table(enc: str) -> tuple[dict[str, int], regex.Pattern]:
    """char -> byte of a one-byte encoding, undefined bytes as the C1 controls they are usually
    decoded to; and a pattern of the runs it can encode that hold a character above ASCII."""
    chars = {}
    for i in range(256):
        try:
            chars[bytes([i]).decode(enc)] = i
        except UnicodeDecodeError:
            pass
    if enc in ("cp1252", "cp1250", "cp1251"):
        for i in range(0x80, 0xA0):
            chars.setdefault(chr(i), i)
    high = "".join(regex.escape(c) for c in chars if ord(c) > 127)
    return chars, regex.compile(rf"[\x00-\x7f]*[{high}][\x00-\x7f{high}]*")


def _decode(raw: bytes, enc: str) -> str | None:
    try:
        if enc == "cp1252":
            return "".join(_back()[b] for b in raw)
        return raw.decode(enc)
    except UnicodeDecodeError:
        return None


@functools.lru_cache(maxsize=1)
def _back() -> list[str]:
    chars, _ = _table("cp1252")
    out = [chr(i) for i in range(256)]
    for c, i in chars.items():
        if not 0x80 <= ord(c) < 0xA0:
            out[i] = c
    return out


def _utf8_in(raw: bytes, rest) -> str | None:
    """raw with its valid multi-byte UTF-8 sequences decoded and the rest given to rest()."""
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            piece = m.group().decode()
        except UnicodeDecodeError:
            continue
        out += [rest(raw[at : m.start()]), piece]
        at = m.end()
    if not at:
        return None
    return "".join([*out, rest(raw[at:])])


_NO_HEX = regex.compile(r"[^0-9A-F]")


def edges(text: str, p: Plausibility):
    """(operation, text) of every state one step away."""
    if _ESCAPED.search(text):
        plain = html.unescape(text)
        plain = regex.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1) or m.group(2), 16)), plain)
        yield "unescape", plain
        yield "iso-2022-jp", _ISO_2022.sub(lambda m: _decode(b"\x1b$B" + m.group(1).encode() + b"\x1b(B", "iso2022_jp") or m.group(), text)
        for dec in ("utf-8", "cp1252"):
            yield f"quoted>{dec}", _QUOTED.sub(lambda m, d=dec: _decode(bytes.fromhex(_NO_HEX.sub("", m.group())), d) or m.group(), text)
    for enc, targets in SINGLE.items():
        chars, runs = _table(enc)
        found = list(runs.finditer(text))
        if not found:
            continue
        raws = [bytes(map(chars.__getitem__, m.group())) for m in found]
        for dec in targets:
            if dec == "utf-8":
                rest = (lambda b: _decode(b, "cp1252")) if enc == "cp1252" else (lambda b, e=enc: b.decode(e, "replace"))
                done = [_utf8_in(r, rest) for r in raws]
            else:
                few = dec in _LATIN  # accents are sparse in Latin text
                done = [_decode(r, dec) if few or _dense(m.group()) else None for r, m in zip(raws, found)]
            if any(x is not None for x in done):
                yield f"{enc}>{dec}", _replaced(text, found, done)
            if enc in _CYRILLIC and dec in _CYRILLIC:  # words of their own, where part of a text is right
                yield f"{enc}>{dec} by words", _STRANGE.sub(lambda m: _swap(m.group(), enc, dec), text)
    if text.isascii():
        return
    odd = _odd_runs(text, p)
    high = [m.span() for m in _RUN.finditer(text)]
    for enc in MULTI:
        choices = []
        try:
            choices.append((None, [text.encode(enc)]))
        except UnicodeEncodeError:
            pass
        for runs in (odd, high):
            found, raws = [], []
            for m in runs:
                try:
                    raws.append(text[m[0] : m[1]].encode(enc))
                    found.append(m)
                except UnicodeEncodeError:
                    pass
            if found:
                choices.append((found, raws))
        for where, raw in choices:
            for dec in ("utf-8", *MULTI):
                if dec == enc:
                    continue
                done = [_utf8_in(r, lambda b, e=enc: b.decode(e, "replace")) if dec == "utf-8" else _decode(r, dec) for r in raw]
                if any(x is not None for x in done):
                    yield f"{enc}>{dec}", done[0] if where is None else _replaced(text, where, done)


_RUN = regex.compile(r"[^\x00-\x7f�\x80-\x9f]{2,}")


def _odd_runs(text: str, p: Plausibility) -> list[tuple[int, int]]:
    """Runs of unknown characters above ASCII, with single known ones between them."""
    out: list[list[int]] = []
    for i, c in enumerate(text):
        if ord(c) > 127 and c not in p.known and not _LOST.match(c):
            if out and i - out[-1][1] <= 1 and (i == out[-1][1] or ord(text[i - 1]) > 127):
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
    return [(a, b) for a, b in out if b - a > 1]


_CYRILLIC = {"cp1251", "koi8_r", "cp866"}
_STRANGE = regex.compile(r"\p{Ll}*[А-ЯЁ][А-ЯЁ]+\p{Ll}*(?:[ ,.:;-]+[а-яё]*[А-ЯЁ]{2,}\p{Ll}*|[ ,.:;-]+[А-ЯЁ](?!\p{L}))*[.:;]?|[^\x00-\x7fа-яА-ЯёЁ](?:[^\x00-\x7f]|[ ,.]+(?=[^\x00-\x7f]))*")


def _swap(run: str, enc: str, dec: str) -> str:
    try:
        return run.encode(enc).decode(dec)
    except UnicodeError:
        return run


def _dense(run: str) -> bool:
    """Is a good part of a run above ASCII? Legacy texts in scripts of their own are."""
    at = [m.start() for m in _HIGH.finditer(run)]
    return len(at) >= 4 and len(at) >= 0.4 * (at[-1] - at[0] + 1)


def _replaced(text: str, found, done) -> str:
    out, at = [], 0
    for m, new in zip(found, done):
        if new is not None:
            start, end = m if isinstance(m, tuple) else m.span()
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


class Plausibility(dict):
    """Cost of characters, known ones from plain text or from the counts of its characters."""

    def __init__(self, plain: str | Mapping[str, int]):
        super().__init__()
        self.seen: dict[str, tuple[str, str]] = {}
        seen = Counter(plain)
        top = max((n for c, n in seen.items() if "Ѐ" <= c <= "ӿ"), default=1)
        # by frequency, as wrong Cyrillic decodings swap letters of one alphabet
        self.cyrillic = {c: min(3.5, 1.0 + 0.25 * math.log2(top / n)) for c, n in seen.items() if "Ѐ" <= c <= "ӿ"}
        self.known = frozenset(c for c, n in seen.items() if n >= 2 and not _LOST.match(c)) | frozenset(map(chr, range(32, 127))) | frozenset("\t\n\r\x1b") | frozenset(_TYPOGRAPHY)

    def __missing__(self, c: str) -> float:
        o, known = ord(c), c in self.known
        kind = unicodedata.category(c)
        if o < 128:
            v = 1.0 if known else 6.0
        elif c in self.cyrillic and known:
            v = self.cyrillic[c]
        elif known:
            v = 2.0 if "㐀" <= c <= "鿿" else 1.5
        elif o == 0xFFFD or 0x80 <= o < 0xA0 or kind in ("Co", "Cn", "Cs"):
            v = 14.0
        elif "㐀" <= c <= "鿿" or "豈" <= c <= "﫿":
            v = 6.0 if self._common(c) else 8.0
        elif "가" <= c <= "힣":
            v = 6.0
        elif "｡" <= c <= "ﾟ":
            v = 4.0
        elif 0xC0 <= o < 0x250 and kind[0] == "L":
            v = 3.0
        elif kind[0] == "L":
            v = 3.5
        elif kind == "Cf":
            v = 3.0
        elif o < 0xC0 or c in "×÷":
            v = 3.5
        else:
            v = 3.0
        self[c] = v
        return v

    @staticmethod
    def _common(c: str) -> bool:
        """First level of GB 2312 or of JIS X 0208."""
        for enc, low, high in (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF)):
            try:
                b = c.encode(enc)
            except UnicodeEncodeError:
                continue
            if len(b) == 2 and low <= b[0] <= high:
                return True
        return False

    def cost(self, text: str) -> float:
        n = sum(map(self.__getitem__, text))
        return n if text.isascii() else n + 3 * len(_ODD_CASE.findall(text))

    def odd(self, text: str) -> bool:
        """Can the search find anything? Only if there is an unknown character, odd case, a pair
        that UTF-8 makes or an escape above ASCII: other texts have the least cost already."""
        return not self.known.issuperset(text) or any(x.search(text) for x in (_SIGN, _ODD_CASE, _ESCAPED))


def search(text: str, p: Plausibility) -> tuple[str, list[str], float]:
    """(cheapest text reached, operations, cost saved). It goes on until no state is left whose cost is near
    enough to the best one, or nothing can be cheaper than the best."""
    first = p.cost(text)
    slack = SLACK + SLACK_PER_SIGN * len(_HIGH.findall(text))
    tick = itertools.count()
    queue = [(first, next(tick), text, [])]
    best, best_cost, best_ops = text, first, []
    visited = {text}
    while queue:
        cost, _, state, ops = heapq.heappop(queue)
        if ops and (cost > best_cost + slack or best_cost <= len(best) + 1e-9):
            break
        for op, new in edges(state, p):
            if new in visited or not new:
                continue
            visited.add(new)
            if not _sound(op, state, new, p):
                continue
            c = p.cost(new)
            if c < best_cost - 1e-9:
                best, best_cost, best_ops = new, c, [*ops, op]
            if c <= cost + slack:
                heapq.heappush(queue, (c, next(tick), new, [*ops, op]))
    return best, best_ops, first - best_cost


def _sound(op: str, old: str, new: str, p: Plausibility) -> bool:
    """Are the characters a step brought plausible ones? Decodings into legacy encodings accept
    nearly any bytes, so theirs must mostly be known; UTF-8 is evidence by itself, and its characters
    need only be of a usual kind."""
    if op == "unescape":
        return True
    fresh = [c for c in new if ord(c) > 127 and c not in old]
    if op.endswith("utf-8"):
        return not fresh or sum(map(p.__getitem__, fresh)) <= 3.1 * len(fresh)
    enc, _, dec = op.partition(">")
    if op == "iso-2022-jp":
        return bool(fresh) and sum(c in p.known for c in fresh) >= 0.75 * len(fresh)
    if dec in _LATIN:
        letters = [c for c in new if c.isalpha()]
        return bool(fresh) and all(c in p.known and c.isalpha() for c in fresh) and 2 * sum(map(str.isascii, letters)) >= len(letters)
    if enc in _CYRILLIC and dec.split()[0] in _CYRILLIC and len({c for c in fresh if c.isalpha()}) < 4:
        return False  # a ruled line isn't a word
    if op.endswith("by words"):
        return True
    return len(fresh) > 1 and sum(c in p.known for c in fresh) >= 0.75 * len(fresh)


_CORE = regex.compile(r"[A-Za-z]?[^\x00-\x7f].*[^\x00-\x7f][@-~]?|[A-Za-z]?[^\x00-\x7f][A-Za-z]?", regex.S)


def examine(text: str | None, p: Plausibility) -> tuple[str, str, bool] | None:
    """(restored text, operations, whole) of a wrongly decoded text, else None. whole: nothing
    lost remains. Null, empty and ASCII texts without escapes are right.

    Only the part from the first to the last character above ASCII is searched, so the same
    text in several fields, with or without comment marks, is searched once.
    """
    if not text or not p.odd(text):
        return None
    m = None if _ESCAPED.search(text) else _CORE.search(text)
    start, end = m.span() if m else (0, len(text))
    core = text[start:end]
    got = p.seen.get(core)
    if got is None:
        best, ops, saved = search(core, p)
        right = not [o for o in ops if o != "unescape"] or saved < 2.5
        got = (core, "") if right else (best, " ".join(ops))
        if len(p.seen) < 50_000:
            p.seen[core] = got
    best, ops = got
    if ops or _LOST.search(core):
        return text[:start] + best + text[end:], ops, not _LOST.search(best)
    return None


_MODELS: dict[int, Plausibility] = {}


def _model(plain: Mapping[str, int]) -> Plausibility:
    k = hash(frozenset(plain.items()))
    if k not in _MODELS:
        _MODELS.clear()
        _MODELS[k] = Plausibility(plain)
    return _MODELS[k]


def garbled(df: DataFrame, key: str, fields: list[str], plain: Mapping[str, int]) -> DataFrame:
    """(key, field, restored, ops, whole): one row per garbled field of each row. Fields of
    plain ASCII without escapes never leave the JVM."""
    needs = r"[^\x00-\x7F]|\$[@B][!-~]|=[89A-F][0-9A-F]=[89A-F]|&(?:#|[A-Za-z])|\\u00|\\x|%[89a-fA-F]"
    cols = [F.when(F.col(f).rlike(needs), F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)]
    src = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *cols)
    src = src.where(F.coalesce(*[F.col(f"f{i}") for i in range(len(fields))]).isNotNull())
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches):
        p = _model(plain)
        for b in batches:
            keys, out = b.column(0), ([], [], [], [], [])
            texts = [b.column(i + 1).to_pylist() for i in range(len(fields))]
            for n in range(b.num_rows):
                for name, column in zip(fields, texts):
                    got = examine(column[n], p)
                    if got:
                        for c, v in zip(out, (n, name, *got)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())],
                names=[key, "field", "restored", "ops", "whole"],
            )

    return src.mapInArrow(run, f"`{key}` {kind}, field string, restored string, ops string, whole boolean")


#: Texts of other characters only can't change a Plausibility: these are known anyway.
_TELLING = r"[^\x20-\x7E\t\n\r\x1B]"


def _characters(batches):
    n = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            n.update(text)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["c", "n"])


def plain_characters(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """How often each character stands in the labelled text of the known languages: all texts of lang_samples and
    all originals of translate_responses, whatever their length, each text once. Texts with signs of damage are left out,
    and so are those that hold no character but known ones (plain ASCII): they never leave the JVM."""

    @F.pandas_udf("boolean")
    def labelled(lang: pd.Series) -> pd.Series:
        return lang.map(lambda x: label(x) in LANGS).astype(bool)

    own = table(spark, sf_dir, "lang_samples").select("text", "lang")
    resp = table(spark, sf_dir, "translate_responses").select(F.col("original_text").alias("text"), F.col("source_lang").alias("lang"))
    src = own.unionByName(resp).where(F.col("text").rlike(_TELLING) & ~F.col("text").rlike(_LOST.pattern))
    texts = src.where(labelled(F.coalesce("lang", F.lit("")))).select("text").distinct()
    counts = texts.mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {r["c"]: r["n"] for r in counts.collect()}


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, field, restored, ops, whole), one row per case; of rows that share a match_id
    the one restored by the fewest operations counts."""
    batch_rows(spark, 4000)
    m = spread(table(spark, sf_dir, "verify_matches").select("match_id", "extracted_text", "raw_match"))
    g = garbled(m, "match_id", ["extracted_text", "raw_match"], plain_characters(spark, sf_dir))
    return g.groupBy("match_id", "field").agg(F.min_by(F.struct("restored", "ops", "whole"), F.struct(F.length("ops"), "restored")).alias("r")).select("match_id", "field", "r.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, field)."""
    batch_rows(spark, 4000)
    m = spread(table(spark, sf_dir, "verify_matches").select("match_id", "extracted_text", "raw_match"))
    return garbled(m, "match_id", ["extracted_text", "raw_match"], plain_characters(spark, sf_dir)).select("match_id", "field").distinct()
