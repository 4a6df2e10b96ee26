"""p2: broken prompt and response pairs.

A response is checked in the order empty, refusal, copy, wrong_language, truncated:

* copied coverage: how much of the answer lies in substrings of the prompt, by a walk over
  the prompt's suffix automaton;
* refusals: an Aho-Corasick automaton over cues of declining and cues of the thing declined;
* language: votes of the words (or signs, in scripts without blanks) that labelled text uses
  often, each weighted by how much it speaks for one language;
* truncation: a stack of open delimiters, the end of the last sentence, the sentences of both
  sides, and the length expected for the pair of languages (medians over all responses).
"""

from __future__ import annotations

import functools
import math
import unicodedata
from bisect import bisect_left
from collections import Counter

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.llm import langid
from loomtext.llm.suffix import Automaton
from loomtext.session import batch_rows, spread, table

VOTERS = 600

#: Covered share from which an answer in the prompt's language is a copy; in no or another language from COPIED_ALL.
COPIED, COPIED_ALL = 0.5, 0.8

#: Cues that someone declines, and cues of what is declined; lower case.
DECLINE = """
can't | cannot | can not | could not | couldn't | won't be able | unable to | not able to | must decline | have to decline | i decline | refuse to | goes against my | against my guidelines | i do not do | not something i | not comfortable | isn't enough context | not enough context | could you share more | need more context | provide more context
kann ich nicht | kann ich leider nicht | ich kann nicht | ich kann diesen | muss ich leider ablehnen | muss ich ablehnen | darf ich | nicht bearbeiten | nicht in der lage | ablehnen | verweigere
je ne peux pas | ne suis pas en mesure | je préfère ne pas | je dois refuser | je refuse | je ne suis pas
no puedo | no me es posible | debo rechazar | prefiero no | no estoy en condiciones | me niego
não consigo | não posso | prefiro não | devo recusar | tenho de recusar | não me é possível | não estou em condições
не могу | не выполняю | придётся отказаться | придется отказаться | отказываюсь | не буду | вынужден отказаться | вынуждена отказаться | не предоставляю
无法 | 不能 | 不便 | 没有办法 | 拒绝 | 不提供 | 无能为力 | 提供更多上下文
できません | お断り | 応えできません | いたしかねます | 控えさせて | 差し控え | 致しかねます
수 없습니다 | 제공하지 않습니다 | 드릴 수 없 | 거절 | 어렵습니다 | 거부
"""
MATTER = """
translate | translating | translation | assist with that | help with that | help with this | this request | that request | your request | the given input | given input | my guidelines | language model | kind of material | this content
übersetzen | übersetzung | sprachmodell | diese anfrage | ihre anfrage
traduire | traduction | modèle de langue | cette demande | votre demande | de répondre
traducir | traducción | modelo de lenguaje | esa solicitud | esta solicitud | su solicitud
traduzir | tradução | modelo de linguagem | esse pedido | este pedido | seu pedido
перевести | перевода | перевод | языковая модель | такие запросы | этот запрос | ваш запрос
翻译 | 译文 | 语言模型 | 该请求 | 这个请求 | 此请求 | 您的请求
翻訳 | 言語モデル | その依頼 | この依頼 | ご依頼 | リクエスト
번역 | 언어 모델 | 이 요청 | 해당 요청 | 요청은
"""

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "“": "”", "«": "»", "《": "》"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_DELIMITER = regex.compile("[" + regex.escape("".join(_OPEN)) + "]")
_FENCED = regex.compile(r"\A\s*```[^\n]*\n?(.*?)\n?```\s*\Z", regex.S)
_PREFIX = regex.compile(r"\A\s*(?:[*_#>\s]*)(?:(?:here is|hier ist|voici|aquí está|aqui está|вот)\b[^:：\n]{0,40}|translation|translated text|übersetzung|traduction|traducción|tradução|перевод|翻译|译文|翻訳|訳文|번역)(?:\s*\([^)\n]{0,20}\))?[*_]*\s*[:：]\s*", regex.I)
_TAIL = regex.compile(r"(?:\s*(?:\[\[?_*\w+_*\]?\]|\[%\([^)\n]*\)\w\]|__\w+__|\[\d+\]))+\s*\Z")
_QUOTES = "\"'“”„«»「」『』`*_ \t\r\n　﻿​"
_ENDED = regex.compile(r"[.!?。！？…:：;)）」』”\"'»\]`]\s*\Z")
_STOP = regex.compile(r"[.!?。！？]")
_CUT_SIGN = regex.compile(r"(?:…|\.\.\.|\[[.…]*\.?\]?)\s*\Z")
_MARK = regex.compile(r"`[^`]+`|\d+")
_ENDS, _UNITS, _MARK_END = regex.compile(r"[.!?。！？\n]+|[:：]\s"), regex.compile(r"(?<=[.!?])(?=\s)|(?<=[。！？])|\n+"), regex.compile(r"[`\d]\W*\Z")
_SPACE = regex.compile(r"\s+")
_ALNUM = regex.compile(r"[^\W_]")


@functools.lru_cache(maxsize=1)
def _refusals():
    a = ahocorasick.Automaton()
    for kind, block in (("decline", DECLINE), ("matter", MATTER)):
        for line in block.strip().splitlines():
            for cue in line.split("|"):
                a.add_word(cue.strip(), kind)
    a.make_automaton()
    return a


def _declines(text: str) -> bool:
    """Does one sentence hold both a cue of declining and a cue of the thing declined?"""
    low = text.lower().replace("’", "'")
    hits = list(_refusals().iter(low))
    if len({kind for _, kind in hits}) < 2:
        return False
    ends = [m.end() for m in _ENDS.finditer(low)]
    by: dict[int, set] = {}
    for e, kind in hits:
        by.setdefault(bisect_left(ends, e + 1), set()).add(kind)
    return any(len(x) == 2 for x in by.values())


def refuses(answer: str, prompt: str) -> bool:
    """Does the answer decline the request? Not where the prompt itself speaks of declining."""
    return _declines(answer) and not _declines(prompt)


_NO_VOTES: dict[str, float] = {}


class Votes:
    """Words of labelled text that vote for languages."""

    def __init__(self, text: dict[str, str], voters: int = VOTERS):
        counts = {k: Counter(self.units(v)) for k, v in text.items()}
        total = {k: sum(c.values()) or 1 for k, c in counts.items()}
        self.votes: dict[str, dict[str, float]] = {}
        for k, c in counts.items():
            for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:voters]:
                here = n / total[k]
                there = max((counts[j][w] / total[j] for j in counts if j != k), default=0.0)
                self.votes.setdefault(w, {})[k] = math.log((here + 1e-5) / (there + 1e-5))
        self.known = {k: frozenset(c) for k, c in counts.items()}

    @staticmethod
    def units(cleaned: str) -> list[str]:
        out = []
        for w in cleaned.split():
            if langid._CJK.search(w):
                out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
                out += list(w)
            else:
                out.append(w)
        return out

    def language(self, text: str) -> tuple[str | None, float]:
        """(language, lead over the next one)."""
        got: dict[str, float] = {}
        for u in self.units(langid.clean(langid.prose(text))):
            for k, v in self.votes.get(u, _NO_VOTES).items():
                got[k] = got.get(k, 0.0) + v
        top = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:2]
        if not top or top[0][1] <= 0:
            return None, 0.0
        return top[0][0], top[0][1] - (top[1][1] if len(top) > 1 else 0.0)


def _without_tail(t: str) -> str:
    return _TAIL.sub("", t) if t.rstrip()[-1:] in ("]", "_") else t


def unwrap(answer: str) -> str:
    """The answer without wrapping marks: fences, quotation marks, a leading title, trailing markers."""
    t = answer.strip(" \t\r\n　﻿​")
    for _ in range(3):
        before = t
        m = _FENCED.match(t) if t.startswith("```") else None
        t = m.group(1) if m else t
        if ":" in t[:120] or "：" in t[:120]:
            t = _PREFIX.sub("", t)
        t = _without_tail(t).strip()
        if len(t) > 1 and (t[0], t[-1]) in {('"', '"'), ("'", "'"), ("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"), ("『", "』"), ("`", "`")} and t[0] not in t[1:-1]:
            t = t[1:-1].strip()
        if t == before:
            break
    return t


def open_delimiters(text: str) -> int:
    """Delimiters still open at the end."""
    ticks = text.count("`") % 2
    if not _DELIMITER.search(text):
        return ticks
    stack: list[str] = []
    for ch in text:
        if ch in _OPEN:
            stack.append(ch)
        elif ch in _CLOSE and stack and stack[-1] == _CLOSE[ch]:
            stack.pop()
    return len(stack) + ticks


def _flat(text: str) -> str:
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", text)).strip().casefold()


def _units(text: str) -> list[str]:
    """Sentences and lines that hold a letter or digit."""
    return [s for s in _UNITS.split(text) if _ALNUM.search(s)]


def _weight(text: str) -> float:
    """Length in which a sign of a script without blanks counts as much as 2.5 letters."""
    return len(text) + 1.5 * len(langid._CJK.findall(text))


def truncated(prompt: str, answer: str, ratio: float, votes: Votes, target: str) -> bool:
    """Does the answer end before the prompt does? ratio: usual length of an answer over its
    prompt, in characters, for the pair of languages."""
    p, a = _without_tail(prompt).rstrip(_QUOTES), _without_tail(answer).rstrip(_QUOTES)
    if not a:
        return False
    if open_delimiters(answer) > open_delimiters(prompt):
        return True
    if _CUT_SIGN.search(a) and not _CUT_SIGN.search(p):
        return True
    if _STOP.search(p[-1:]) and not _STOP.search(a[-1:]):
        return True
    up, ua = _units(p), _units(a)
    # digits and code spans of the prompt stand in a whole answer, too
    marks = _MARK.findall(up[-1]) if up else []
    lost = set(marks) - set(_MARK.findall(ua[-1])) if ua else set(marks)
    if len(ua) < len(up):
        if lost or set(_MARK.findall(p)) - set(_MARK.findall(a)):
            return True
        if marks:
            return False
        return len(a) / max(1.0, ratio * len(p)) < (0.75 if len(up) - len(ua) == 1 else 0.85)
    if len(ua) > len(up):
        return False
    expected = ratio * len(up[-1])
    size = len(ua[-1]) / max(1.0, expected)
    if size < 0.35:
        return True
    if size >= 0.82 or size < 0.45:
        return size < 0.45
    last = langid.clean(ua[-1]).split()
    odd = bool(last) and not langid._CJK.search(last[-1]) and last[-1] not in votes.known.get(target, ()) and not _MARK_END.search(ua[-1])
    short = 0.82 if lost or odd else 0.45
    return size < short


def copied(prompt: str, answer: str) -> float:
    """Share of the answer's characters that lie in long substrings of the prompt, by a walk over the
    prompt's suffix automaton. A share below COPIED decides nothing and is given as 0: the automaton is made
    only where the substrings of the least length that both share could cover so much."""
    least = min(4 if langid._CJK.search(prompt) else 12, len(answer))
    known = {prompt[i : i + least] for i in range(len(prompt) - least + 1)}
    shared = sum([answer[i : i + least] in known for i in range(len(answer) - least + 1)])
    if shared * least < COPIED * len(answer):
        return 0.0
    return Automaton(prompt).coverage(answer, least) / max(1, len(answer))


def defect(prompt: str | None, answer: str | None, source: str | None, target: str | None, ratios: dict, model: langid.Model, votes: Votes) -> str | None:
    """The defect of one response, or None.

    None also where nothing can be judged: a null or wordless prompt, equal or unknown
    languages on both sides. Whether the prompt holds words of a language is the dearest question and is
    asked only of suspects.
    """
    src, tgt = langid.label(source), langid.label(target)
    if src is None and tgt is None or src == tgt or not prompt:
        return None
    found = _suspect(prompt, answer or "", src, tgt, ratios, votes)
    return found if found and model.segments(prompt) else None


def _suspect(prompt: str, answer: str, src: str | None, tgt: str | None, ratios: dict, votes: Votes) -> str | None:
    body = unwrap(answer)
    if not _ALNUM.search(body):
        return "empty"
    if refuses(answer, prompt):
        return "refusal"
    lang, lead = votes.language(body)
    covered = copied(_flat(prompt), _flat(body)) if lang != tgt else 0.0  # an answer in the target language is no copy
    if covered >= COPIED_ALL and lang != tgt:
        return "copy"
    if lang is not None and tgt is not None and lang not in (src, tgt) and lead > 1.5:
        return "wrong_language"
    if lang == src and lang != tgt and covered >= COPIED:
        return "copy"
    if lang == tgt or lang is None or lead <= 1.5:
        ratio = ratios.get((src, tgt)) or ratios.get(("", tgt)) or 1.0
        if truncated(prompt, body, ratio, votes, tgt or ""):
            return "truncated"
    return None


@F.pandas_udf(StringType())
def _code(label: pd.Series) -> pd.Series:
    return label.map(langid.label)


def usual_ratios(responses: DataFrame) -> dict[tuple[str, str], float]:
    """Median length of an answer over its original by pair of languages, over all rows. Labels
    are mapped to the nine codes before the grouping, so there are at most 100 groups."""
    rows = (
        responses.where((F.length("original_text") >= 20) & (F.length("translated_text") > 0))
        .select(_code("source_lang").alias("s"), _code("target_lang").alias("t"), (F.length("translated_text") / F.length("original_text")).alias("r"))
        .where("s IS NOT NULL AND t IS NOT NULL")
        .groupBy("s", "t").agg(F.percentile_approx("r", 0.5, 1000).alias("r"), F.count("*").alias("n")).collect()
    )
    out = {(r["s"], r["t"]): r["r"] for r in rows if r["n"] >= 5}
    for t in langid.LANGS:
        own = [v for (_, b), v in out.items() if b == t]
        if own:
            out["", t] = sorted(own)[len(own) // 2]
    return out


@functools.lru_cache(maxsize=1)
def _votes_of(key: tuple) -> Votes:
    return Votes(dict(key))


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, defect), defect null for sound pairs; one row per response_id, the first by
    ts where several differ. Rows without response_id are dropped."""
    batch_rows(spark, 2000)
    resp = table(spark, sf_dir, "translate_responses").where(F.col("response_id").isNotNull())
    text, ratios = langid.labelled(spark, sf_dir), usual_ratios(resp)
    key = tuple(sorted(text.items()))

    @F.pandas_udf("string")
    def judged(p: pd.Series, a: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        m, v = langid.model_of(text), _votes_of(key)
        return pd.Series([defect(*x, ratios, m, v) for x in zip(p, a, s, t)], dtype=object)

    r = spread(resp.select("response_id", "original_text", "translated_text", "source_lang", "target_lang", "ts"))
    r = r.select("response_id", "ts", judged("original_text", "translated_text", "source_lang", "target_lang").alias("defect"))
    return r.groupBy("response_id").agg(F.min_by("defect", F.struct("ts", "defect")).alias("defect"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(spark, sf_dir).where(F.col("defect").isNotNull())


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by defect; sound ones as none."""
    return defects(spark, sf_dir).groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_responses"))
