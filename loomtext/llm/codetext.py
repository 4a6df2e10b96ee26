"""p7: natural language hidden inside code.

Comments and string literals are cut out of code by the lexical rules of its file type, and
literals are unescaped. Each sentence or line of them is broken into the subwords of a public
tokenizer and scored under unigram counts of every language and of an explicit class for
code; the class with the greatest posterior is chosen.

The language counts come from labelled text, the counts of the code class from code itself: the
parts of a bounded sample of code matches that lie outside comments and literals, the
identifiers in them broken up, and a short list of literals that are no language.
"""

from __future__ import annotations

import functools
import html
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm import langid, tokens
from loomtext.session import batch_rows, spread, table

VOCABULARY = "byte_bpe_multi_50k"
CODE_ROWS = 2000
CODE_TEXT, CODE_LINES = 5000, 20_000
LABEL_ROWS, LABEL_CHARS = 15_000, 80_000
CODE_PRIOR = 0.5

_DQ = r'"(?:\\.|[^"\\\n])*"'
_SQ = r"'(?:\\.|[^'\\\n])*'"
_BT = r"`(?:\\.|[^`\\])*`"
_SLASH, _BLOCK, _HASH, _DASH = r"//[^\n]*", r"/\*.*?\*/", r"\#[^\n]*", r"--[^\n]*"
_TRIPLE = r'[rRbBuUfF]{0,2}(?:"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\')'

#: File types: patterns of comments and of literals.
RULES = {
    "js mjs cjs ts tsx jsx mts cts": ([_BLOCK, _SLASH], [_DQ, _SQ, _BT]),
    "go": ([_BLOCK, _SLASH], [_DQ, _BT, r"'(?:\\.|[^'\\\n])'"]),
    "java kt kts scala sc swift rs": ([_BLOCK, _SLASH], [r'r(\#+)".*?"\1', r'""".*?"""', _DQ]),
    "c h cpp cc cxx hpp hh hxx": ([_BLOCK, _SLASH], [_DQ, r"'(?:\\.|[^'\\\n])'"]),
    "cs": ([_BLOCK, _SLASH], [r'@"(?:""|[^"])*"', _DQ, r"'(?:\\.|[^'\\\n])'"]),
    "php": ([_BLOCK, _SLASH, r"\#(?!\[)[^\n]*"], [_DQ, _SQ]),
    "py pyw pyi": ([_HASH], [_TRIPLE, _DQ, _SQ]),
    "rb rake": ([r"^=begin\b.*?^=end\b", r"\#(?!\{)[^\n]*"], [_DQ, _SQ]),
    "sh bash zsh fish yaml yml toml ini conf txt": ([r"(?:^|(?<=\s))\#[^\n]*"], [_DQ, r"(?<!\w)'(?:''|[^'\n])*'"]),
    "ps1 psm1 psd1": ([r"<\#.*?\#>", _HASH], [_DQ, _SQ]),
    "lua": ([r"--\[\[.*?\]\]", _DASH], [r"\[\[.*?\]\]", _DQ, _SQ]),
    "sql mysql pgsql": ([_BLOCK, _DASH], [r"'(?:''|[^'])*'"]),
    "html htm xml svg md markdown vue": ([r"<!--.*?-->"], [r"(?<==)\s*" + _DQ, r"(?<==)\s*" + _SQ]),
    "bat cmd": ([r"(?:^|(?<=\n))\s*(?:REM\b|::)[^\n]*"], []),
}
#: Of unknown types only what is a comment in most of them.
_OTHER = ([_BLOCK, r"(?<!:)//[^\n]*", r"(?:^|(?<=\s))\#[^\n]*"], [_DQ])


@functools.lru_cache(maxsize=None)
def _lexer(ext: str) -> regex.Pattern:
    comments, literals = next((v for k, v in RULES.items() if ext in k.split()), _OTHER)
    c = "|".join(f"(?:{x})" for x in comments)
    s = "|".join(f"(?:{x})" for x in literals) or r"(?!)"
    s = regex.sub(r"\\1", r"\\g<fence>", s.replace(r"r(\#+)", r"r(?P<fence>\#+)"))
    return regex.compile(rf"(?P<comment>{c})|(?P<literal>{s})", regex.S | regex.M)


_TAG = regex.compile(r"<[A-Za-z][^<>]*>|<!--.*?-->", regex.S)
_ESCAPE = regex.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([nrtbfav0\"'\\`/]))")
_PLAIN = {"n": "\n", "r": "\n", "t": "\t", "0": " ", "a": " ", "b": " ", "f": " ", "v": " "}
_MARKS = regex.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|///?!?|//+|\#+|--+(?:\[\[)?|<!--|;+|REM\b|::|<\#|=begin|=end)?[ \t]*|[ \t]*(?:\*+/|-->|\]\]|\#>)[ \t]*$", regex.M | regex.I)
_JOINED = regex.compile(r"\s*(?:\+|\.\.?|\|\||&|\\)\s*\Z")


def unescape(text: str) -> str:
    """Escapes of literals as the characters they stand for; surrogate pairs are joined."""

    def one(m):
        code = m.group(1) or m.group(2) or m.group(3) or m.group(4)
        if not code:
            return _PLAIN.get(m.group(5), m.group(5))
        n = int(code, 16)
        return chr(n) if n < 0x110000 else m.group()

    t = _ESCAPE.sub(one, text)
    if any("\ud800" <= c <= "\udfff" for c in t):
        t = t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return html.unescape(t) if "&" in t else t


def _inner(literal: str) -> str:
    m = _OPENING.match(literal)
    if not m:
        return literal
    end = {"[[": "]]"}.get(m.group(2), m.group(2)) + m.group(1)
    body = literal[m.end() :]
    body = body[: -len(end)] if body.endswith(end) else body
    if m.group(2) == "'":
        body = body.replace("''", "'")
    return body


def extract(code: str, ext: str) -> tuple[list[tuple[str, str]], str]:
    """([(kind, text)], rest): comments and literals of code, and what is left without them.
    Line comments on following lines are joined, and so are literals joined by an operator."""
    ext = (ext or "").lower().lstrip(".")
    lexer, out, rest = _lexer(ext), [], []
    markup = ext in "html htm xml svg vue".split()
    spans = [m.span() for m in _TAG.finditer(code)] if markup else [(0, len(code))]
    for start, stop in spans:
        at = start
        for m in lexer.finditer(code, start, stop):
            gap = code[at : m.start()]
            kind = "comment" if m.group("comment") is not None else "literal"
            if kind == "comment":
                text = _MARKS.sub("", m.group())
            else:
                text = unescape(_inner(m.group()))
            joined = out and out[-1][0] == kind and at > start and (gap.strip() == "" and gap.count("\n") <= 1 if kind == "comment" else gap.strip() != "" and _JOINED.match(gap) is not None)
            if joined:
                out[-1] = (kind, out[-1][1] + ("\n" if kind == "comment" else "") + text)
            else:
                out.append((kind, text))
            rest.append(gap)
            at = m.end()
        rest.append(code[at:stop])
    return out, " ".join(rest)


#: Beginnings of directives to tools, and of database statements.
_DIRECTIVE = regex.compile(
    r"^\W*(?:noqa|pylint|type:\s*ignore|mypy|flake8|isort|fmt:|yapf|eslint|tslint|jshint|jslint|prettier|stylelint|@?ts-(?:ignore|nocheck|expect|check)|@flow|istanbul|c8 ignore|nolint|clang-|cppcheck|coverity|rustfmt|clippy|allow\(|"
    r"shellcheck|rubocop|frozen_string_literal|vim?:|ex:|emacs:|-\*-|coding[:=]|spdx|copyright \(c\)|\+build|go:|region\b|endregion|pragma(?:\s*:|\s+(?:once|no|mark|omp|pack|warning|message|region|endregion|clang|gcc)\b)|include\s*[<\"']|define\s+(?-i:[A-Z_][A-Z0-9_]*)\b|resharper|sonar(?:\s*:|\W*(?:on|off|ignore|disable|enable)\b)|noinspection|luacheck|phpcs|phpstan|psalm|yamllint|sql-formatter|!/|@(?:param|return|throws|see|since|author)\b)", regex.I)
_KEYWORDS = r"(?:SELECT\b.+\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|VIEW|INDEX|OR)\b|ALTER\s+TABLE\b|DROP\s+(?:TABLE|VIEW|INDEX)\b|GRANT\s+\w+\s+ON\b|MERGE\s+INTO\b)"
_COLUMN = r"(?:\*|[\w.`\"]+(?:\([^()]*\))?(?:\s+as\s+\w+)?)"
_REST = r"\s+[\w.`\"]+(?:\s+(?:as\s+)?\w)?\s*(?:$|[;,)(]|\b(?:where|join|left|inner|outer|cross|order\s+by|group\s+by|limit|union|having|using)\b)"
#: In small letters a statement must have its syntax, as sentences begin with the same words.
_STATEMENT = regex.compile(
    rf"^\W*(?:(?-i:{_KEYWORDS})|select\s+(?:distinct\s+)?{_COLUMN}(?:\s*,\s*{_COLUMN})*\s+from{_REST}|insert\s+into\s+[\w.`\"]+\s*(?:\(|values\b|select\b)|update\s+[\w.`\"]+\s+set\s+[\w.`\"]+\s*=|delete\s+from{_REST}|"
    r"create\s+(?:or\s+replace\s+)?(?:unique\s+)?(?:table|view|index)\s+(?:if\s+not\s+exists\s+)?[\w.`\"]+\s*(?:\(|\b(?:as\s*\(?\s*select|on\s+\w+\s*\())|alter\s+table\s+[\w.`\"]+\s+(?:add|drop|alter|rename|modify)\b|drop\s+(?:table|view|index)\s+(?:if\s+exists\s+)?[\w.`\"]+\s*(?:;|$)|"
    r"with\s+\w+\s+as\s*\(|grant\s+\w+\s+on\s+\S+\s+to\b|merge\s+into\s+\S+(?:\s+\w+)?\s+using\b)", regex.I | regex.S)
_LABEL = regex.compile(r"^\W*(?:todo|fixme|note|hack|xxx|bug|warning|info)\b(?:\([^)\n]*\))?\s*[:：-]?\s*", regex.I)

#: Literals that are keys, paths, addresses, patterns or formats.
NO_LANGUAGE = """
application/json | text/html; charset=utf-8 | %Y-%m-%d %H:%M:%S | /var/log/app/error.log | https://example.test/path?query=1#top | ^[A-Z]{2,4}-[0-9]+$ | utf-8 | en_US.UTF-8 | btn btn-primary mt-2
Content-Type | X-Request-Id | user.name | v1.2.3-beta | {0}/{1} | %s: %d | *.tmp | sha256 | a1b2c3d4 | aGVsbG8= | 127.0.0.1:8080 | true false null | int return const let var def end function public static void class
select id from table where n > 1 order by name | set ts=4 sw=4 et | disable-next-line no-console | ignore[arg-type] | import os.path as p | if x == 1: return None | for i in range(10): pass | x = y + 1; | [ -f file ] && rm -f file | $x = $y % 2; | a.fetch(:key, 1)
"""


_JOINTS, _DIGITS = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|_+"), regex.compile(r"\d+")
_OPENING = regex.compile(r"\s*(?:@|[rRbBuUfF]{0,2})(\#*)(\"\"\"|'''|\[\[|[\"'`])")


class Classes:
    """Unigram counts of subwords per language and for code."""

    def __init__(self, text: dict[str, str], code: str, folder: str = tokens.TOKENIZERS):
        self.encode = tokens.encoder(VOCABULARY, folder).encode_ordinary
        lines = {k: v.split("\n") for k, v in text.items()}
        lines["code"] = [*code.split("\n"), *(x.strip() for x in NO_LANGUAGE.replace("\n", "|").split("|"))]
        counts = {k: Counter(i for line in v for i in self.encode(self.shape(line))) for k, v in lines.items()}
        self.names = sorted(counts)
        sizes = {k: sum(c.values()) for k, c in counts.items()}
        vocabulary = len(set().union(*counts.values())) + 1
        alpha = 0.1
        self.table: dict[int, list[float]] = {}
        base = {k: math.log(sizes[k] + alpha * vocabulary) for k in self.names}
        self.unseen = [math.log(alpha) - base[k] for k in self.names]
        for i in set().union(*counts.values()):
            self.table[i] = [math.log(counts[k][i] + alpha) - base[k] for k in self.names]
        self.prior = [math.log(CODE_PRIOR if k == "code" else (1 - CODE_PRIOR) / max(1, len(self.names) - 1)) for k in self.names]
        self.best = functools.lru_cache(maxsize=1 << 15)(self._best)

    @staticmethod
    def shape(line: str) -> str:
        """Identifiers broken up: joints by case, digits and low lines become blanks."""
        return " " + _DIGITS.sub("0", _JOINTS.sub(" ", line)).strip().lower()

    def _best(self, line: str) -> tuple[str, float]:
        """(class, posterior) of a line: code if it outweighs all languages together, else the
        greatest of the languages."""
        score = list(self.prior)
        for i in self.encode(self.shape(line)):
            for j, v in enumerate(self.table.get(i, self.unseen)):
                score[j] += v
        top = max(range(len(score)), key=score.__getitem__)
        weight = [math.exp(max(-700.0, s - score[top])) for s in score]
        total = sum(weight)
        code = self.names.index("code")
        if self.names[top] == "code" and 2 * weight[code] < total:
            top = max((j for j in range(len(score)) if j != code), key=score.__getitem__)
        return self.names[top], weight[top] / total


def languages(code: str | None, ext: str, m: Classes) -> list[tuple[str, str, int, float]]:
    """[(kind, language, letters, posterior)] of every sentence in the comments and literals of
    code. A sentence has three words, or four signs of a script without blanks, and a class
    other than code."""
    out = []
    for kind, text in extract(code or "", ext)[0]:
        for line in langid._CUT.split(langid._SPAN.sub(" # ", text)):
            line = _LABEL.sub("", line.strip())
            if not line or _DIRECTIVE.match(line) or _STATEMENT.match(line):
                continue
            c = langid.clean(line)
            cjk = len(langid._CJK.findall(c))
            n = sum(len(w) > 1 for w in c.split())
            if cjk < 4 and n < 3:
                continue
            lang, p = m.best(line)
            if lang != "code":
                out.append((kind, lang, sum(map(len, c.split())), p))
    return out


def letters(text: str) -> int:
    """Letters as langid.clean() counts them, code included."""
    return sum(map(len, langid._LETTER.findall(text.lower())))


def whole(code: str | None, ext: str) -> int:
    """Letters of code with all it holds; escapes in literals count as the letters they stand for."""
    code = code or ""
    n = letters(code)
    if "\\" in code or "&" in code:
        for m in _lexer((ext or "").lower().lstrip(".")).finditer(code):
            if m.group("literal") is not None:
                n += letters(unescape(_inner(m.group()))) - letters(_inner(m.group()))
    return n


_MODELS: dict[int, Classes] = {}


def _model(text: dict[str, str], code: str, folder: str) -> Classes:
    k = hash((tuple(sorted(text.items())), code, folder))
    if k not in _MODELS:
        _MODELS.clear()
        _MODELS[k] = Classes(text, code, folder)
    return _MODELS[k]


def code_sample(spark: SparkSession, sf_dir: str, rows: int = CODE_ROWS, longest: int = CODE_TEXT, lines_at_most: int = CODE_LINES) -> str:
    """Code without comments and literals of the first rows matches in the order of a hash: a bounded sample for the
    unigram counts of the code class. Matches of more than longest characters aren't taken into it, and of its
    distinct lines the first lines_at_most in their order, so it doesn't grow with the table."""
    code = table(spark, sf_dir, "verify_matches").where(F.lower(F.trim("category")) == "code")
    some = langid.by_hash(code.select("match_id", "path", "extracted_text"), "match_id", rows).where(F.length("extracted_text") <= longest)
    got = sorted(some.limit(2 * rows).collect(), key=lambda r: (r["h"], r["path"] or ""))[:rows]
    lines = set()
    for r in got:
        ext = (r["path"] or "").rsplit(".", 1)[-1]
        lines |= {x.strip() for x in extract(r["extracted_text"], ext)[1].split("\n") if x.strip()}
    return "\n".join(sorted(lines)[:lines_at_most])


def found(spark: SparkSession, sf_dir: str, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(match_id, path, sentences array<kind, lang, letters>, whole) of the matches of category code;
    whole are all letters of the match. Null texts and unknown file types give what most file types have in common."""
    batch_rows(spark, 2000)
    text, code = langid.labelled(spark, sf_dir, LABEL_ROWS, LABEL_CHARS, distinct=False), code_sample(spark, sf_dir)
    rows = table(spark, sf_dir, "verify_matches").where((F.lower(F.trim("category")) == "code") & F.col("extracted_text").isNotNull() & F.col("match_id").isNotNull())
    src = spread(rows.select("match_id", "path", "extracted_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("lang", pa.string()), ("letters", pa.int32())]))

    def run(batches):
        m = _model(text, code, folder)
        for b in batches:
            texts = [((p or "").rsplit(".", 1)[-1], t) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            got = [
                [{"kind": k, "lang": lang, "letters": n} for k, lang, n, _ in languages(t, e, m)]
                for e, t in texts
            ]
            total = pa.array([whole(t, e) for e, t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, kind), total], names=["match_id", "path", "sentences", "whole"])

    return src.mapInArrow(run, "match_id long, path string, sentences array<struct<kind: string, lang: string, letters: int>>, whole long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, lang)."""
    return found(spark, sf_dir).select("match_id", F.explode(F.array_distinct(F.transform("sentences", lambda s: s["lang"]))).alias("lang")).distinct()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, letters, share): letters of each language in the comments and literals of a
    file's code, and their share of all letters of that code, which is the rest of the file. Matches
    delivered twice count once; a language that a file doesn't hold has no row; a null path is a
    file of its own."""
    one = found(spark, sf_dir).groupBy("match_id").agg(F.min(F.struct("path", "sentences", "whole")).alias("r")).select("r.*")
    pair = lambda lang, n: F.struct(lang.alias("lang"), n.cast("long").alias("letters"))

    # all letters of a match stand beside its sentences, as a row without language
    parts = F.concat(F.array(pair(F.lit(None).cast("string"), F.col("whole"))), F.transform("sentences", lambda s: pair(s["lang"], s["letters"])))
    per = one.select("path", F.explode(parts).alias("s")).groupBy("path", "s.lang").agg(F.sum("s.letters").alias("letters"))
    total = F.max(F.when(F.col("lang").isNull(), F.col("letters"))).over(W.partitionBy("path"))  # a row per language
    return per.withColumn("total", total).where("lang IS NOT NULL").select("path", "lang", "letters", F.round(F.col("letters") / F.col("total"), 6).alias("share"))
