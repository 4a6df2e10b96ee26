"""Lexical rules of 23 kinds of source files, and the patterns built from them."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    exts: tuple[str, ...]
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    doc: tuple[str, ...] = ()
    quotes: tuple[str, ...] = ()
    template: bool = False
    raw: tuple[str, ...] = ()
    multiline: tuple[str, ...] = ()


_C, _HTML = (("/*", "*/"),), (("<!--", "-->"),)

# Names, extensions and marks of every kind of file.
RULES = (
    Rule("javascript", ("js", "mjs", "cjs"), ("//",), _C, ("/**", "///"), ('"', "'"), True),
    Rule("javascript", ("ts", "tsx", "mts", "cts"), ("//",), _C, ("/**", "///"), ('"', "'"), True),
    Rule("javascript", ("jsx",), ("//",), _C, ("/**", "///"), ('"', "'"), True),
    Rule("python", ("py", "pyw", "pyi"), ("#",), (), ('"""', "'''"), ('"', "'"), False, ('r"', "r'", 'r"""', "r'''"), ('"""', "'''")),
    Rule("rust", ("rs",), ("//",), _C, ("///", "/**"), ('"',), False, ("r#", 'r"')),
    Rule("go", ("go",), ("//",), _C, (), ('"', "'"), True),
    Rule("java", ("java",), ("//",), _C, ("/**",), ('"',)),
    Rule("c", ("c", "h"), ("//",), _C, (), ('"', "'")),
    Rule("c", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), ("//",), _C, ("///", "/**"), ('"', "'")),
    Rule("csharp", ("cs",), ("//",), _C, ("///",), ('"', "'"), False, ('@"', "@'")),
    Rule("kotlin", ("kt", "kts"), ("//",), _C, ("/**",), ('"',), False, (), ('"""',)),
    Rule("swift", ("swift",), ("//",), _C, ("///",), ('"',), False, (), ('"""',)),
    Rule("ruby", ("rb", "rake"), ("#",), (("=begin", "=end"),), (), ('"', "'")),
    Rule("php", ("php",), ("//", "#"), _C, ("/**",), ('"', "'")),
    Rule("lua", ("lua",), ("--",), (("--[[", "]]"),), ("---",), ('"', "'"), False, (), ("[[", "]]")),
    Rule("scala", ("scala", "sc"), ("//",), _C, (), ('"',), False, (), ('"""',)),
    Rule("shell", ("sh", "bash", "zsh", "fish"), ("#",), (("<#", "#>"),), (), ('"', "'")),
    Rule("powershell", ("ps1", "psm1", "psd1"), ("#",), (("<#", "#>"),), (), ('"', "'")),
    Rule("batch", ("bat", "cmd"), ("REM", "::")),
    Rule("sql", ("sql", "mysql", "pgsql"), ("--",), _C, (), ("'",)),
    Rule("html", ("html", "htm", "xml", "svg"), (), _HTML, (), ('"', "'")),
    Rule("markdown", ("md", "markdown"), (), _HTML),
    Rule("config", ("yaml", "yml", "toml", "ini", "conf", "txt"), ("#", ";"), (), (), ('"', "'")),
)


def rule_of(ext: str | None) -> Rule | None:
    """First rule that lists the extension, in any case."""
    e = (ext or "").lower().lstrip(".")
    return next((r for r in RULES if e in r.exts), None)


def supported_extensions() -> list[str]:
    return sorted({e for r in RULES for e in r.exts})


#: Kinds of regions, and the nodes they make.
NODES = {
    "line_comment": "comment", "block_comment": "comment", "doc_comment": "doc_string", "raw_string": "string_literal",
    "multiline_string": "string_literal", "template_string": "string_literal", "string_literal": "string_literal",
}


@functools.lru_cache(maxsize=None)
def arms(rule: Rule) -> tuple[tuple[str, str, str], ...]:
    """(kind, prefix, pattern) in the order of precedence: doc, block, line, raw, multiline,
    template, quote. A prefix at a place commits to its arm, even if the arm then fails; so where
    two prefixes of a group overlap the longer one stands first."""
    out: list[tuple[str, str, str]] = []
    e = re.escape
    line_docs = {"///", "---", "//!"}
    for d in sorted(rule.doc, key=len, reverse=True):
        if d in line_docs:
            out.append(("doc_comment", d, e(d) + r"[^\r\n]*"))
        elif d == "/**":
            out.append(("doc_comment", d, e(d) + r"(?s:.*?)\*/"))
        else:
            out.append(("doc_comment", d, e(d) + r"(?s:.*?)" + e(d)))
    out += [("block_comment", a, e(a) + r"(?s:.*?)" + e(b)) for a, b in rule.block]
    out += [("line_comment", p, e(p) + r"[^\r\n]*") for p in rule.line]
    for p in rule.raw:  # only a hash leaves room for the quotation mark after the prefix
        n = p.count("#")
        out.append(("raw_string", p, e(p) + r'"(?s:.*?)"' + "#" * n if n else r"(?!)"))
    out += [("multiline_string", p, e(p) + r"(?s:.*?)" + e(p)) for p in rule.multiline if p not in rule.doc]
    if rule.template:
        out.append(("template_string", "`", ""))
    out += [("string_literal", q, q + rf"(?:[^{q}\\\r\n]|\\(?:(?s:.)|\z))*(?:{q}|\z)") for q in rule.quotes]
    return tuple(out)


def pattern(rule: Rule, java: bool = True) -> str:
    """One alternation of the arms; each later arm is kept from the places of earlier prefixes.
    Only for rules without template strings. Without java: plain RE2, for rules whose prefixes
    don't overlap."""
    if rule.template:
        raise ValueError(f"{rule.name} has template strings, which are no regular language")
    out, seen = [], []
    for kind, prefix, p in arms(rule):
        if p == "(?!)":
            seen.append(prefix)
            continue
        if java:
            p = p.replace(r"\\\r\n]|\\(", r"\\\r\n]++|\\(").replace(r"(?:(?s:.)|\z))*(", r"(?:(?s:.)|\z))*+(")
        ahead = "".join(f"(?!{re.escape(s)})" for s in seen if s.startswith(prefix[:1]) or prefix.startswith(s[:1])) if java else ""
        out.append(ahead + p)
        seen.append(prefix)
    return "|".join(f"(?:{x})" for x in out)


@functools.lru_cache(maxsize=None)
def _starts(rule: Rule) -> tuple[re.Pattern, tuple[tuple[str, str, re.Pattern | None], ...]]:
    own = [(k, p, re.compile(x.replace(r"\z", r"\Z")) if k != "template_string" else None) for k, p, x in arms(rule)]
    return re.compile("|".join(re.escape(p) for _, p, _ in own)), tuple(own)


def template_end(text: str, start: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the template string at start, and its placeholders ${...} (absolute ranges). Braces
    are counted, backticks inside a placeholder open template strings of their own, the end of
    the text closes everything."""
    i, n, spans = start + 1, len(text), []
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, spans
        elif c == "$" and text.startswith("${", i):
            at, depth, i = i, 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "\\":
                    i += 1
                elif c == "`":
                    i = template_end(text, i)[0] - 1
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                i += 1
            spans.append((at, min(i, n)))
        else:
            i += 1
    return n, spans


def scan(text: str, rule: Rule) -> list[tuple[str, int, int, int, int, list[tuple[int, int]]]]:
    """[(kind, full_start, full_end, content_start, content_end, placeholders)] in characters;
    placeholders are relative to the content. The first region at a place wins; the search goes on
    behind it."""
    starts, own = _starts(rule)
    out, pos = [], 0
    while m := starts.search(text, pos):
        at = m.start()
        kind, prefix, p = next(x for x in own if text.startswith(x[1], at))
        spans: list[tuple[int, int]] = []
        if kind == "template_string":
            end, spans = template_end(text, at)
            full = end
        else:
            hit = p.match(text, at)
            if not hit:
                pos = at + 1
                continue
            full = hit.end()
        a, b = content(kind, prefix, rule, text, at, full)
        out.append((kind, at, full, a, b, [(s - a, e - a) for s, e in spans]))
        pos = max(full, at + 1)
    return out


def content(kind: str, prefix: str, rule: Rule, text: str, start: int, end: int) -> tuple[int, int]:
    """Range of the content in a region."""
    a = start + len(prefix)
    if kind == "line_comment" or kind == "doc_comment" and prefix in ("///", "---", "//!"):
        return (a + 1 if text[a : a + 1] == " " and a < end else a), end
    if kind == "block_comment" or prefix == "/**":
        b = end - len(next((y for x, y in rule.block if x == prefix), "*/"))
        if b > a and text[a] == " ":
            a += 1
        if b > a and text[b - 1] == " ":
            b -= 1
        return a, b
    if kind == "raw_string":
        return a + 1, end - 1 - prefix.count("#")
    # an unterminated literal loses its last character, as the end of the text closes it
    return a, max(a, end - len(prefix))
