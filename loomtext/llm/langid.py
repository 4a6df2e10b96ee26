"""p4: the language of texts and of their segments by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A sentence is parsed against each
automaton into the longest known substrings; the language that needs the fewest phrases for
it wins, and the distance to the next language gives the confidence.

Labelled text: lang_samples, and a bounded sample of the originals of translate_responses,
whose source_lang is true: the first SAMPLE_ROWS rows in the order of a hash, at most
SAMPLE_CHARS characters a language. Both bounds are parameters; texts of more than SAMPLE_TEXT characters
aren't taken into the sample, so that no single text fills it.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.suffix import Automaton
from loomtext.session import batch_rows, spread, table

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 24_000
SAMPLE_TEXT = 2000

LANGS = ("de", "en", "es", "fr", "ja", "ko", "pt", "ru", "zh")

#: Codes (ISO 639), names and usual aliases of the nine languages, lower case.
ALIASES = {
    "en": "en eng english anglais englisch inglés inglês английский 英语 英語 영어",
    "zh": "zh zho chi chs cht cn cmn chinese mandarin zhongwen 中文 汉语 漢語 简体中文 繁體中文 中国語 중국어 chinesisch chinois chino chinês китайский",
    "ja": "ja jpn jp jap japanese nihongo 日本語 日语 일본어 japanisch japonais japonés japonês японский",
    "ko": "ko kor kr korean hangul 한국어 韩语 韓国語 koreanisch coréen coreano корейский",
    "ru": "ru rus russian русский 俄语 ロシア語 러시아어 russisch russe ruso russo",
    "de": "de deu ger german deutsch 德语 ドイツ語 독일어 allemand alemán alemão немецкий",
    "fr": "fr fra fre french français francais 法语 フランス語 프랑스어 französisch francés francês французский",
    "es": "es spa esp spanish castilian español espanol castellano 西班牙语 スペイン語 스페인어 spanisch espagnol espanhol испанский",
    "pt": "pt por ptb portuguese português portugues brazilian 葡萄牙语 ポルトガル語 포르투갈어 portugiesisch portugais portugués португальский",
}
_ALIAS = {a: k for k, v in ALIASES.items() for a in v.split()}

#: Labels that name no language.
NO_LANGUAGE = set("auto und unknown unk n/a na none null nil undefined undetermined mul mis zxx xx any other ? - detect autodetect".split()) | {""}


_HEAD = regex.compile(r"[-_\s.,;/(@]+")


@functools.lru_cache(maxsize=1 << 14)
def label(raw: str | None) -> str | None:
    """One of LANGS, "other" for another language, None for a label that names none."""
    s = unicodedata.normalize("NFC", raw or "").strip().strip("[](){}<>\"'.,;:").lower()
    if s in NO_LANGUAGE or not any(c.isalpha() for c in s):
        return None
    if s in _ALIAS:
        return _ALIAS[s]
    head = _HEAD.split(s, maxsplit=1)[0]
    if head in NO_LANGUAGE:
        return None
    return _ALIAS.get(head, "other")


_FENCE = regex.compile(r"```.*?(?:```|\Z)", regex.S)
_TICKS = regex.compile(r"`[^`\n]*`")
_SPAN = regex.compile(r"`[^`\n]*`|\$?\{\{?[^{}\n]*\}?\}|\[?%\([^)\n]*\)[sdf]\]?|\[\[?[\w%:.]*\]?\]|__\w+__|<[^<>\n]{1,80}>|\b[A-Za-z][A-Za-z0-9+.-]*://\S+|[\w.+-]+@[\w-]+\.[\w.]+|\x1b\[[0-9;]*m")
_RARE = regex.compile(r"[{}%\[<@\x1b]|__|://")
_CODED = regex.compile(r"[0-9_/\\=%#@$<>{}|~^*+]|[A-Za-z][.:][A-Za-z0-9]|[a-z][A-Z]")
_TOKEN = regex.compile(r"[\x21-\x7e]*(?:[0-9_/\\=%#@$<>{}|~^*+]|(?<=[A-Za-z])[.:](?=[A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))[\x21-\x7e]*")
_CUT = regex.compile(r"(?<=[.!?…])[\"'”’»)\]}]*(?=\s|$)|(?<=[。！？｡])[”’」』）)\]\"']*|[\r\n]+|(?<=[:：;])\s+")
_LETTER = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_CJK = regex.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힣ｦ-ﾟ]")
_KANA = regex.compile(r"[ぁ-ゖァ-ヺｦ-ﾟ]")
_HANGUL = regex.compile(r"[가-힣ᄀ-ᇿ]")
_REPEAT = regex.compile(r"(\p{L})\1{3,}|(?<!\p{L})(\p{L})\2+(?!\p{L})")


def clean(sentence: str) -> str:
    """Lower-case words of a sentence, without code, numbers and marks."""
    s = _TOKEN.sub(" ", sentence) if _CODED.search(sentence) else sentence
    s = _REPEAT.sub(" ", s)
    return " ".join(_LETTER.findall(s.lower()))


def prose(text: str) -> str:
    """A text without code blocks, code spans and addresses."""
    t = unicodedata.normalize("NFC", text)
    if "`" in t:
        t = _TICKS.sub(" ", _FENCE.sub("\n", t))
    return _SPAN.sub(" ", t) if _RARE.search(t) else t


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text without code blocks, code spans and addresses."""
    t = prose(text)
    return [s for s in (x.strip(" \t　​﻿([{<>*#-–—•\"'“”«»「」") for x in _CUT.split(t)) if s]


def words(c: str) -> int:
    """Size of a cleaned sentence: words, or half the signs of scripts without blanks."""
    n = 0 if c.isascii() else len(_CJK.findall(c))
    return n // 2 if n else sum(len(w) > 1 for w in c.split(" "))


class Model:
    """Automata of labelled text. text: language -> labelled text (cleaned sentences)."""

    def __init__(self, text: dict[str, str]):
        self.langs = sorted(text)
        self.auto = {k: Automaton(v) for k, v in text.items()}
        self.alphabet = {k: frozenset(v) for k, v in text.items()}
        self.size = {k: max(2, len(v)) for k, v in text.items()}
        self.detect = functools.lru_cache(maxsize=1 << 15)(self._detect)

    def _detect(self, c: str) -> tuple[str | None, float, float]:
        """(language, confidence, mean phrase length) of a cleaned sentence."""
        if not c or not self.langs:
            return None, 0.0, 0.0
        own = set(c)
        strange = {k: len(own - a) for k, a in self.alphabet.items()}
        best = second = 1 << 60
        lang = None
        # a foreign letter is a phrase of its own, so strange is a lower bound of the phrases
        for k in sorted(self.langs, key=lambda x: (strange[x], x)):
            if strange[k] > second:
                continue
            n = self.auto[k].phrases(c, second)
            if n < best:
                best, second, lang = n, best, k
            elif n < second:
                second = n
        if lang == "zh" and _KANA.search(c):
            lang = "ja"
        if second > len(c):
            second = len(c) + 1
        # phrases cost log2(size) bits each; capped, as parses of one text aren't independent
        odds = min(30.0, (second - best) * math.log2(self.size[lang]) / 2)
        return lang, 1.0 / (1.0 + 2.0 ** -odds), len(c) / best

    def segments(self, text: str | None, hint: frozenset[str] = frozenset()) -> list[tuple[str, float, int, str]]:
        """[(language, confidence, words, sentence)] of the sentences that hold words. A hint
        decides only between languages that need equally many phrases."""
        out = []
        for s in sentences(text or ""):
            c = clean(s)
            n = words(c)
            if not c or n == 0:
                continue
            lang, conf, mean = self.detect(c)
            cjk = bool(_CJK.search(c))
            if lang is None or mean < (1.3 if cjk else 2.5) or (n == 1 and mean < (2 if cjk else 4)):
                continue
            if hint and conf <= 0.5 and lang not in hint:
                tied = [k for k in self.langs if k in hint and self.auto[k].phrases(c) <= self.auto[lang].phrases(c)]
                lang = tied[0] if tied else lang
            out.append((lang, conf, n, s))
        return out


def whole(lang: str, conf: float, n: int) -> bool:
    """Is a segment a sentence whose language is sure?"""
    return conf >= 0.95 and n >= 3


def judge(segments: list[tuple[str, float, int, str]], raw_label: str | None) -> tuple[str | None, float, list[tuple[str, str]]]:
    """(language, confidence, [(issue, language)]) of a text from its segments."""
    if not segments:
        return None, 0.0, []
    weight: dict[str, float] = {}
    for lang, conf, n, _ in segments:
        weight[lang] = weight.get(lang, 0.0) + n * conf
    main = max(sorted(weight), key=lambda k: weight[k])
    conf = weight[main] / max(1e-9, sum(n for _, _, n, _ in segments))
    sure = sorted({lang for lang, c, n, _ in segments if whole(lang, c, n)})
    if len(sure) > 1:
        return main, conf, [("mixed", k) for k in sure]
    if sure:
        main = sure[0]
    named = label(raw_label)
    if named is None:
        return main, conf, [("missing", main)]
    return main, conf, [] if named == main else [("wrong", main)]


_MODELS: dict[int, Model] = {}


def model_of(text: dict[str, str]) -> Model:
    """The model of a labelled text, one per worker process."""
    key = hash(tuple(sorted(text.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(text)
    return _MODELS[key]


def by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About the first rows rows of df in the order of a hash of the key, with the hash as h:
    those below a limit that follows from the number of rows. So only the sample moves,
    whatever the size of the table."""
    h, n = F.xxhash64(key), df.count()
    out = df.withColumn("h", h)
    return out if n <= rows else out.where(h < F.lit(int(-(1 << 63) + min(1.0, 1.25 * rows / n) * ((1 << 64) - 1024))))


def sampled(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_TEXT) -> list[tuple[str, str]]:
    """[(language, text)]: the samples, then the bounded sample of responses."""
    own = table(spark, sf_dir, "lang_samples").select("lang", "text").orderBy(F.xxhash64("text"), "text", "lang").limit(rows).collect()
    resp = by_hash(table(spark, sf_dir, "translate_responses"), "response_id", rows)
    resp = resp.where(F.col("original_text").isNotNull() & (F.length("original_text") <= longest)).select("h", F.col("original_text").alias("text"), F.col("source_lang").alias("lang"))
    first = sorted(resp.limit(2 * rows).collect(), key=lambda r: (r["h"], r["text"], r["lang"] or ""))[:rows]
    return [(k, r["text"]) for r in [*own, *first] if r["text"] and (k := label(r["lang"])) in LANGS]


def labelled(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, distinct: bool = True) -> dict[str, str]:
    """Labelled text per language: cleaned sentences of sampled(), each once if distinct."""
    return gathered(sampled(spark, sf_dir, rows), chars, distinct)


def gathered(samples: list[tuple[str, str]], chars: int = SAMPLE_CHARS, distinct: bool = True) -> dict[str, str]:
    seen: dict[str, list[str]] = {k: [] for k in LANGS}
    once: set[tuple[str, str]] = set()
    used = dict.fromkeys(LANGS, 0)
    for k, text in samples:
        for s in sentences(text):
            c = clean(s)
            if c and used[k] < chars and not (distinct and (k, c) in once):
                once.add((k, c))
                seen[k].append(c)
                used[k] += len(c) + 1
    return {k: "\n".join(v) for k, v in seen.items() if v}


_RESULT = "struct<lang: string, confidence: double, issues: array<struct<issue: string, lang: string>>>"
_SEGMENTS = "array<struct<lang: string, confidence: double, words: int, text: string>>"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, 2000)
    conf = table(spark, sf_dir, "translate_configs").groupBy("config_hash").agg(F.first("source_langs").alias("hint"))
    req = table(spark, sf_dir, "translate_requests").where(F.col("request_id").isNotNull())
    return spread(req.select("request_id", "config_hash", "text", "source_lang", "ingested_at")).join(conf, "config_hash", "left")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, lang, confidence, issues): one row per request, of the delivery ingested
    first. Texts without words, null and blank texts have a null language and no issue."""
    text = labelled(spark, sf_dir)

    @F.pandas_udf(_RESULT)
    def judged(t: pd.Series, given: pd.Series, hint: pd.Series) -> pd.DataFrame:
        m = model_of(text)
        rows = []
        for x, g, h in zip(t, given, hint):
            named = frozenset(filter(None, map(label, h))) if h is not None else frozenset()
            lang, conf, issues = judge(m.segments(x, named), g)
            rows.append((lang, conf, [{"issue": i, "lang": k} for i, k in issues]))
        return pd.DataFrame(rows, columns=["lang", "confidence", "issues"])

    r = _requests(spark, sf_dir).select("request_id", "ingested_at", judged("text", "source_lang", "hint").alias("r"))
    return r.groupBy("request_id").agg(F.min_by("r", F.struct("ingested_at", "r")).alias("r")).select("request_id", "r.*")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("request_id", "lang", F.round("confidence", 4).alias("confidence"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, segment, lang, confidence, words, text): runs of sentences of one language."""
    text = labelled(spark, sf_dir)

    @F.pandas_udf(_SEGMENTS)
    def runs(t: pd.Series, hint: pd.Series) -> pd.Series:
        m = model_of(text)
        out = []
        for x, h in zip(t, hint):
            named = frozenset(filter(None, map(label, h))) if h is not None else frozenset()
            merged: list[dict] = []
            for lang, conf, n, s in m.segments(x, named):
                if merged and merged[-1]["lang"] == lang:
                    a = merged[-1]
                    a["confidence"] = (a["confidence"] * a["words"] + conf * n) / (a["words"] + n)
                    a["words"] += n
                    a["text"] += " " + s
                else:
                    merged.append({"lang": lang, "confidence": conf, "words": n, "text": s})
            out.append(merged)
        return pd.Series(out)

    r = _requests(spark, sf_dir).select("request_id", "ingested_at", runs("text", "hint").alias("r"))
    one = r.groupBy("request_id").agg(F.min_by("r", F.struct("ingested_at", "r")).alias("r"))
    return one.select("request_id", F.posexplode("r").alias("segment", "s")).select(
        "request_id", "segment", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.words", "s.text"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, issue, lang)."""
    return labels(spark, sf_dir).select("request_id", F.explode("issues").alias("i")).select("request_id", "i.issue", "i.lang")
