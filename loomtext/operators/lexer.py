"""Regions of comments and literals in source texts.

File types without template strings are lexed by one regular expression each inside the
JVM; those with template strings (backticks nest, so they are no regular language) by an
Arrow UDF. Both give the same rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext import lang_rules as R
from loomtext.functions import scalars as C
from loomtext.functions.scripts import contains_target
from loomtext.operators import clean as K
from loomtext.operators import filters as P

_PLACES = ("full_start", "full_end", "content_start", "content_end")
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_POINT = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("offset", T.IntegerType())])
REGIONS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("content", T.StringType()), T.StructField("raw", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in _PLACES],
    T.StructField("start", _POINT), T.StructField("end", _POINT), T.StructField("placeholders", T.ArrayType(_SPAN)),
]))


def rule_name(ext: Column) -> Column:
    """Name of the rule of an extension in any case; null for an unknown one."""
    e = F.lower(ext)
    return reduce(lambda a, r: a.when(e.isin(list(r.exts)), r.name), R.RULES, F.when(F.lit(False), F.lit("")))


def language_table(spark) -> DataFrame:
    """(ext, name): the rules as rows, for joins. Of an extension in several rules the first counts."""
    seen: dict[str, str] = {}
    for r in R.RULES:
        for e in r.exts:
            seen.setdefault(e, r.name)
    return spark.createDataFrame(sorted(seen.items()), "ext string, name string")


def can_parse(ext: Column) -> Column:
    return F.lower(ext).isin(R.supported_extensions())


def regular_tokens(text: Column, ext: Column) -> Column:
    """Full texts of the regions, in order; null for unknown types and those with template strings."""
    e = F.lower(ext)
    rules = [r for r in R.RULES if not r.template]
    return reduce(lambda a, r: a.when(e.isin(list(r.exts)), F.regexp_extract_all(text, F.lit(R.pattern(r)), F.lit(0))), rules, F.when(F.lit(False), F.array(F.lit(""))))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(rule: R.Rule) -> str:
    """SQL of struct<kind, content, raw> of a region's full text x by a rule: the first prefix that stands there decides."""
    kinds, contents = [], []
    for k, prefix, _ in R.arms(rule):
        hit, size = f"startswith(x, {_quoted(prefix)})", len(prefix)
        if k == "line_comment" or k == "doc_comment" and prefix in ("///", "---", "//!"):
            inner = f"substring(x, {size + 1}, length(x))"
            inner = f"if(substring(x, {size + 1}, 1) = ' ', substring(x, {size + 2}, length(x)), {inner})"
        elif k == "block_comment" or prefix == "/**":
            inner = f"substring(x, {size + 1}, length(x) - {size + len(next((y for o, y in rule.block if o == prefix), '*/'))})"
            inner = f"regexp_replace(regexp_replace({inner}, '^ ', ''), ' \\\\z', '')"
        elif k == "raw_string":
            inner = f"substring(x, {size + 2}, length(x) - {size + 2 + prefix.count('#')})"
        else:
            inner = f"substring(x, {size + 1}, greatest(0, length(x) - {2 * size}))"
        kinds.append(f"WHEN {hit} THEN '{k}'")
        contents.append(f"WHEN {hit} THEN {inner}")
    return f"named_struct('kind', CASE {' '.join(kinds)} END, 'content', CASE {' '.join(contents)} END, 'raw', x)"


def regular_regions(text: str, ext: str) -> Column:
    """array<struct<kind, content, raw>> of the file types without template strings, inside the JVM; null for
    others. text and ext are names of columns; one SQL expression is built, as it is far larger than a planner likes
    to get call by call."""
    arms = []
    for r in R.RULES:
        if not r.template:
            exts = ", ".join(map(_quoted, r.exts))
            arms.append(f"WHEN lower(`{ext}`) IN ({exts}) THEN transform(regexp_extract_all(`{text}`, {_quoted(R.pattern(r))}, 0), x -> {_parts(r)})")
    return F.expr(f"CASE {' '.join(arms)} END")


class Places:
    """Line, column and offset (from 1, 1 and 0; in bytes) of ascending places of a text, in one pass."""

    def __init__(self, text: str):
        self.text, self.ascii, self.at = text, text.isascii(), 0
        self.line, self.column, self.offset = 1, 1, 0

    def __call__(self, at: int) -> dict[str, int]:
        if at < self.at:
            self.__init__(self.text)
        part = self.text[self.at : at]
        size = len(part) if self.ascii else len(part.encode())
        lines = part.count("\n")
        if lines:
            tail = part[part.rfind("\n") + 1 :]
            self.line += lines
            self.column = 1 + (len(tail) if self.ascii else len(tail.encode()))
        else:
            self.column += size
        self.offset += size
        self.at = at
        return {"line": self.line, "column": self.column, "offset": self.offset}


@F.pandas_udf(REGIONS)
def regions(text: pd.Series, ext: pd.Series) -> pd.Series:
    """Regions of a text by the rule of its extension; null for a null text or unknown type."""
    out = []
    for t, e in zip(text, ext):
        rule = R.rule_of(e)
        if t is None or rule is None:
            out.append(None)
            continue
        place = Places(t)
        out.append([
            {"kind": k, "content": t[c:d], "raw": t[a:b], "full_start": a, "full_end": b, "content_start": c, "content_end": d, "start": place(c), "end": place(d), "placeholders": [{"start": s, "end": x} for s, x in ph]}
            for k, a, b, c, d, ph in R.scan(t, rule)
        ])
    return pd.Series(out, dtype=object)


def node_type(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in R.NODES.items() for x in kv])[kind]


def node_priority(node: Column) -> Column:
    return F.when(node == "doc_string", 1).when(node == "comment", 2).when(node == "string_literal", 3)


def is_comment(kind: Column) -> Column:
    return kind.isin("line_comment", "block_comment", "doc_comment")


def is_string(kind: Column) -> Column:
    return kind.isin("raw_string", "multiline_string", "template_string", "string_literal")


def is_doc(kind: Column) -> Column:
    return kind == "doc_comment"


def wanted(kind: Column, comments: bool = True, docs: bool = True, strings: bool = True) -> Column:
    on = [k for k, s in (("line_comment", comments), ("block_comment", comments), ("doc_comment", docs), *((x, strings) for x in ("raw_string", "multiline_string", "template_string", "string_literal"))) if s]
    return kind.isin(on)


def should_extract(kind: Column, content: Column, least: int = 2, most: int = 10_000, langs: list[str] | None = None, comments: bool = True, docs: bool = True, strings: bool = True) -> Column:
    """Non-empty, of a wanted kind, of a byte length within the bounds, in a wanted language."""
    n = F.octet_length(content)
    return F.coalesce((n > 0) & n.between(least, most) & wanted(kind, comments, docs, strings) & contains_target(content, langs or []), F.lit(False))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "content", "raw")])))
def _template_regions(text: pd.Series, ext: pd.Series) -> pd.Series:
    out = []
    for t, e in zip(text, ext):
        rule = R.rule_of(e)
        out.append(None if t is None or rule is None else [{"kind": k, "content": t[c:d], "raw": t[a:b]} for k, a, b, c, d, _ in R.scan(t, rule)])
    return pd.Series(out, dtype=object)


def lexed(files: DataFrame, text: str = "text", ext: str = "ext", places: bool = True) -> DataFrame:
    """One row per region: all columns of files but the text, and idx, kind, content, raw_match,
    start and end struct<line, column, offset> (column and offset in bytes), placeholders.
    Files of unknown types have no regions. idx counts the regions of a file before any filter.
    Without places only idx, kind, content and raw_match are given: then types without template strings are lexed
    inside the JVM, and only the others are handed to Python."""
    keep = [c for c in files.columns if c != text]
    t, e = F.col(text), F.col(ext)
    if places:
        r = files.select(*keep, F.posexplode(regions(t, e)).alias("idx", "__r"))
        more = [F.col("__r." + c).alias(c) for c in ("start", "end", "placeholders")]
    else:
        nested = F.lower(e).isin([x for r in R.RULES if r.template for x in r.exts])
        found = F.coalesce(_template_regions(F.when(nested, t), e), regular_regions(text, ext))
        r = files.select(*keep, F.posexplode(found).alias("idx", "__r"))
        more = []
    return r.select(*keep, "idx", F.col("__r.kind").alias("kind"), F.col("__r.content").alias("content"), F.col("__r.raw").alias("raw_match"), *more)


def units(files: DataFrame, cfg: P.FilterConfig | None = None, source_langs: list[str] | None = None, target: str = "EN", least: int = 0, most: int = 100_000, path: str = "path", places: bool = True) -> DataFrame:
    """Translation units of files(path, ext, text): cleaned by kind and filtered; the code check is
    off for comments. id is path, kind and idx."""
    r = lexed(files, places=places)
    kind, c = F.col("kind"), F.col("content")
    cleaned = F.when(kind == "doc_comment", K.doc_comment(c)).when(kind == "block_comment", K.block_comment(c)).otherwise(c)
    r = r.where(should_extract(kind, c, least, most)).withColumn("content", cleaned)
    keep = F.when(is_comment(kind), P.composite(F.col("content"), cfg, source_langs, target, check_code=False)).otherwise(P.composite(F.col("content"), cfg, source_langs, target))
    return r.where(keep).withColumn("node_type", node_type(kind)).withColumn("id", F.concat_ws("_", path, "kind", F.col("idx").cast("string"))).withColumn("pattern_type", F.lit("Builtin")).withColumn("pattern_name", F.lit(None).cast("string"))


def verify_matches(u: DataFrame, *more: str) -> DataFrame:
    """Match rows of units: names default by node type, category string or other; the raw match
    is the region's exact text. position is left out where the units have no places; more columns may be kept."""
    node = F.col("node_type")
    return u.select(
        "path", F.coalesce("pattern_name", F.when(node == "comment", "comment").when(node == "doc_string", "docstring").otherwise("string_literal")).alias("pattern_name"),
        F.coalesce("pattern_type", F.lit("Builtin")).alias("pattern_type"), F.when(node == "string_literal", "string").otherwise("other").alias("category"),
        F.col("content").alias("extracted_text"), *([F.col("start").alias("position")] if "start" in u.columns else []), "raw_match", *more,
    )


_PLACED = "array<struct<line:int,column:int,offset:int,idx:int>>"


def _after(place, text: Column):
    """(line, column, offset) behind a text that begins at a place."""
    line, column, offset = place
    size, lines = F.octet_length(text), F.regexp_count(text, F.lit("\n")).cast("int")
    return line + lines, F.when(lines > 0, F.octet_length(F.substring_index(text, "\n", -1)) + 1).otherwise(column + size), offset + size


def _matches_of(text: Column, p: dict) -> Column:
    """array of a pattern's matches with their places, which are carried along from match to match."""
    whole, parts = F.regexp_extract_all(text, F.lit(p["regex"]), F.lit(0)), F.split(text, p["regex"], -1)
    steps = F.zip_with(whole, F.slice(parts, F.lit(1), F.greatest(F.size(whole), F.lit(0))), lambda m, x: F.struct(m.alias("m"), F.coalesce(x, F.lit("")).alias("before")))
    none = F.array().cast(_PLACED)
    zero = F.struct(F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(0).alias("offset"), none.alias("out"))

    def step(acc, x):
        start = _after((acc["line"], acc["column"], acc["offset"]), x["before"])
        line, column, offset = _after(start, x["m"])
        here = F.struct(start[0].alias("line"), start[1].alias("column"), start[2].alias("offset"), F.size(acc["out"]).alias("idx"))
        return F.struct(line.alias("line"), column.alias("column"), offset.alias("offset"), F.array_append(acc["out"], here).alias("out"))

    places = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    g = int(p.get("group", 0))

    def row(m, at):
        got = F.regexp_extract(m, p["regex"], g) if g else m
        return F.struct(
            at["idx"].alias("idx"), F.lit(p["name"]).alias("pattern_name"), F.lit("CustomRegex").alias("pattern_type"), F.lit(p.get("category", "other")).alias("category"), m.alias("raw_match"),
            F.coalesce(F.nullif(got, F.lit("")), m).alias("content"), F.struct(at["line"].alias("line"), at["column"].alias("column"), at["offset"].alias("offset")).alias("start"),
        )

    return F.zip_with(whole, places, row)


def custom_matches(files: DataFrame, patterns: list[dict], text: str = "text", ext: str = "ext") -> DataFrame:
    """Matches of user patterns: dicts of name, regex, group, extensions, category. A pattern for
    "*" (or for no extension) runs only on files whose extension no pattern names. A group that
    isn't there gives the whole match. Positions are real ones. All patterns run in one pass over the files."""
    named = sorted({e.lower().lstrip(".") for p in patterns for e in p.get("extensions") or [] if e != "*"})
    keep = [c for c in files.columns if c != text]
    kind = "array<struct<idx:int,pattern_name:string,pattern_type:string,category:string,raw_match:string,content:string,start:struct<line:int,column:int,offset:int>>>"
    none, e = F.array().cast(kind), F.lower(F.col(ext))
    each = []
    for p in patterns:
        exts = [x.lower().lstrip(".") for x in p.get("extensions") or [] if x != "*"]
        mine = e.isin(exts) if exts else ~e.isin(named) if named else F.lit(True)
        each.append(F.coalesce(F.when(mine, _matches_of(F.col(text), p).cast(kind)), none))
    return files.select(*keep, F.explode(F.concat(*each) if each else none).alias("__m")).select(*keep, "__m.*")


def merged_units(*branches: DataFrame, key=("path",)) -> DataFrame:
    """Union of branches with start and end offsets and content; of equal (start, end, content) of
    a file the first branch stays. The first branch is not deduplicated in itself."""
    rows = reduce(DataFrame.unionByName, (b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)))
    from pyspark.sql import Window as W

    w = W.partitionBy(*key, "start_offset", "end_offset", "content").orderBy("branch", "idx")
    first = F.row_number().over(w)
    return rows.withColumn("__n", first).where((F.col("branch") == 0) | (F.col("__n") == 1)).drop("__n")
