"""Queries over source files: encodings, scans, lexing, units and matches, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext import lang_rules as R
from loomtext.functions import encoding as E
from loomtext.functions import scalars as C
from loomtext.functions import scripts as S
from loomtext.operators import lexer as X
from loomtext.sources import scan as N
from loomtext.session import spread, table

# File types whose prefixes don't overlap have an exact twin in RE2.
PLAIN = [r for r in R.RULES if r.name in ("c", "ruby", "shell", "sql", "html", "config") and "///" not in r.doc]
PLAIN_EXTS = sorted(e for r in PLAIN for e in r.exts)


def sources(spark, sf_dir):
    """(path, ext, text): contents in valid UTF-8, without their marks. Rows delivered twice stay, as only a shuffle of
    contents could part them; queries reduce their own results."""
    f = table(spark, sf_dir, "source_files").select("path", "ext", "content").where(E.is_utf8(F.col("content")))
    return f.select("path", "ext", E.to_text(F.col("content"), F.lit("UTF-8")).alias("text"))


def texts(spark, sf_dir):
    """(path, ext, text): contents in any encoding, without their marks; rows delivered twice stay."""
    return table(spark, sf_dir, "source_files").select("path", "ext", E.any_text(F.col("content")).alias("text"))


def marked(spark, sf_dir):
    """texts() with the digest of the content and a number of the row. What is counted per row is the same for every
    delivery of a content, so once() takes one of them, and contents are never shuffled."""
    f = table(spark, sf_dir, "source_files").select("path", "ext", F.sha2("content", 256).alias("sha"), F.monotonically_increasing_id().alias("row"), "content")
    return f.select("path", "ext", "sha", "row", E.any_text(F.col("content")).alias("text"))


def once(rows, keys, *counts):
    """Counts per row of marked() (and keys), then one row per path, content and keys."""
    per = rows.groupBy("path", "ext", "sha", "row", *keys).agg(*counts)
    names = [c for c in per.columns if c not in ("path", "ext", "sha", "row", *keys)]
    return per.groupBy("path", "ext", "sha", *keys).agg(*[F.max(c).alias(c) for c in names])


_TEXT = "(SELECT DISTINCT path, ext, regexp_replace(try(decode(content)), '\\A\\x{FEFF}', '') AS text FROM source_files WHERE try(decode(content)) IS NOT NULL)"


def lex_tokens(spark, sf_dir):
    """Regions of the file types without template strings and lookahead, as
    its SQL knows no others; lex_tokens_all() gives those of all files."""
    f = sources(spark, sf_dir).where(F.col("ext").isin(PLAIN_EXTS))
    return f.select("path", "ext", F.posexplode(X.regular_tokens(F.col("text"), F.col("ext"))).alias("idx", "raw")).select("path", "ext", F.col("idx").cast("long").alias("idx"), "raw", F.octet_length("raw").cast("long").alias("bytes")).distinct()


_ARMS = " ".join(f"WHEN ext IN ({', '.join(map(repr, r.exts))}) THEN regexp_extract_all(text, '{R.pattern(r, java=False).replace(chr(39), chr(39) * 2)}', 0)" for r in PLAIN)
LEX_TOKENS = f"""WITH f AS {_TEXT}, t AS (SELECT path, ext, CASE {_ARMS} END AS a FROM f)
SELECT DISTINCT path, ext, i AS idx, a[i + 1] AS raw, strlen(a[i + 1]) AS bytes FROM t, LATERAL (SELECT unnest(range(len(a)))) u(i)"""


def lex_tokens_all(spark, sf_dir):
    """Regions of all file types, in any encoding."""
    r = X.lexed(spread(texts(spark, sf_dir)))
    return r.select("path", "ext", F.col("idx").cast("long").alias("idx"), F.col("raw_match").alias("raw"), F.octet_length("raw_match").cast("long").alias("bytes")).distinct()


def lex_all(spark, sf_dir):
    """Regions of all file types with their places."""
    r = X.lexed(spread(marked(spark, sf_dir)))
    one = once(r, ["kind"], F.count("*").alias("n"), F.sum(F.octet_length("raw_match")).alias("bytes"), F.max("start.line").alias("last_line"))
    return one.groupBy("ext", "kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("last_line").alias("last_line"))


def lex_agree(spark, sf_dir):
    """Both lexers over the file types that both know; files on which they differ (none)."""
    f = texts(spark, sf_dir).where(~F.lower("ext").isin([e for r in R.RULES if r.template for e in r.exts]))
    u = F.transform(X.regions(F.col("text"), F.col("ext")), lambda x: F.substring(F.col("text"), x["full_start"] + 1, x["full_end"] - x["full_start"]))
    return spread(f).where(~F.coalesce(X.regular_tokens(F.col("text"), F.col("ext")), F.array().cast("array<string>")).eqNullSafe(F.coalesce(u, F.array().cast("array<string>")))).select("path", "ext")


LEX_AGREE = "SELECT path, ext FROM source_files WHERE false"


def unit_counts(spark, sf_dir):
    """Units of all files, as matches, counted by every group."""
    m = X.verify_matches(X.units(spread(marked(spark, sf_dir)), source_langs=["zh", "ja", "ko", "ru"], places=False), "ext", "sha", "row")
    one = once(m, ["pattern_name", "pattern_type", "category"], F.count("*").alias("n"))
    files = one.groupBy("path", "pattern_name", "pattern_type", "category").agg(F.sum("n").alias("n"))
    return files.groupBy("pattern_name", "pattern_type", "category").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


def file_types(spark, sf_dir):
    """Rules of the files' extensions, and files that can be parsed."""
    f = table(spark, sf_dir, "source_files").select("path", "ext").distinct()
    j = f.join(F.broadcast(X.language_table(spark)), "ext", "left")
    return j.groupBy("ext").agg(F.first("name").alias("name"), F.count("*").alias("n"), F.max(X.can_parse(F.col("ext"))).alias("known"))


_LANG = ", ".join(f"('{e}', '{n}')" for e, n in sorted({e: r.name for r in reversed(R.RULES) for e in r.exts}.items()))
FILE_TYPES = f"WITH l(ext, name) AS (VALUES {_LANG}) SELECT f.ext, any_value(l.name) AS name, count(*) AS n, bool_or(l.ext IS NOT NULL) AS known FROM (SELECT DISTINCT path, ext FROM source_files) f LEFT JOIN l ON lower(f.ext) = l.ext GROUP BY 1"


def all_extensions(spark, sf_dir):
    """Every known extension."""
    return X.language_table(spark).select("ext").distinct().orderBy("ext")


ALL_EXTENSIONS = f"WITH l(ext, name) AS (VALUES {_LANG}) SELECT DISTINCT ext FROM l"

_RULES = ["*.lua", "/amber-core", "!amber-core/src/**", "tests", "lib/*", "**/*.sql", "#none", "", "docs/"]


def scanned_files(spark, sf_dir):
    """Include, exclude and ignore rules over paths."""
    f = table(spark, sf_dir, "source_files").select("path").distinct()
    rules = N.parse_ignores(_RULES)
    p = F.col("path")
    return f.select("path", N.is_ignored(p, rules).alias("ignored"), N.include_file(p, ["*.py", "**/*.rs", "*core*"], ["**/scripts"], rules[:1]).alias("included"), N.match_recursive(p, "amber-core/**/*.py").alias("recursive"), F.size(N.parents(p)).cast("long").alias("depth"))


_PARTS = "string_split(path, '/')"
SCANNED_FILES = rf"""WITH f AS (SELECT DISTINCT path, {_PARTS} AS p, {_PARTS}[-1] AS name FROM source_files),
r AS (SELECT *, len(list_filter(p, lambda x: regexp_matches(x, '\A.*\.lua'))) > 0 AS r1, regexp_matches(p[1], '\Aamber-core') AS r2, regexp_matches(path, 'amber-core/src/') AS r3,
  len(list_filter(p, lambda x: regexp_matches(x, '\Atests'))) > 0 AS r4, len(list_filter(range(1, len(p)), lambda i: regexp_matches(p[i], '\Alib'))) > 0 AS r5, ends_with(path, '.sql') AS r6 FROM f)
SELECT path, CASE WHEN r6 OR r5 OR r4 THEN true WHEN r3 THEN false ELSE r2 OR r1 END AS ignored,
  (ends_with(path, '.py') OR ends_with(name, '.rs') OR contains(path, 'core')) AND NOT ends_with(path, 'scripts')
  AND NOT r1 AND len(list_filter(range(1, len(p)), lambda i: ends_with(array_to_string(p[1:i], '/'), 'scripts'))) = 0 AS included,
  starts_with(path, 'amber-core/') AND ends_with(name, '.py') AS recursive, len(p) - 1 AS depth FROM r"""


def file_encodings(spark, sf_dir):
    """Encodings of the files, by a cascade."""
    f = table(spark, sf_dir, "source_files").select("path", "content")
    c = F.col("content")
    d = E.detect(c)
    utf8 = F.octet_length(c) == 0
    return spread(f).select("path", F.sha2(c, 256).alias("sha"), E.bom(c).alias("bom"), E.is_ascii(c).alias("ascii"), E.is_utf8(c).alias("utf8"), F.octet_length(E.without_bom(c)).cast("long").alias("rest"), F.when(E.is_utf8(c) | utf8 | E.bom(c).isNotNull(), d["confidence"]).alias("confidence")).distinct()


FILE_ENCODINGS = """WITH f AS (SELECT DISTINCT path, content, hex(content) AS h FROM source_files)
SELECT path, sha256(content) AS sha, CASE WHEN starts_with(h, 'EFBBBF') THEN 'UTF-8' WHEN starts_with(h, 'FFFE') THEN 'UTF-16LE' WHEN starts_with(h, 'FEFF') THEN 'UTF-16BE' END AS bom,
  NOT regexp_matches(h, '\\A(?:..)*?[89A-F].(?:..)*\\z') AS ascii, try(decode(content)) IS NOT NULL AS utf8,
  octet_length(content) - CASE WHEN starts_with(h, 'EFBBBF') THEN 3 WHEN h LIKE 'FFFE0000%' OR h LIKE '0000FEFF%' THEN 4 WHEN starts_with(h, 'FFFE') OR starts_with(h, 'FEFF') THEN 2 ELSE 0 END AS rest,
  CASE WHEN octet_length(content) = 0 OR starts_with(h, 'EFBBBF') OR starts_with(h, 'FFFE') OR starts_with(h, 'FEFF') THEN 1.0 WHEN try(decode(content)) IS NULL THEN NULL
       WHEN NOT regexp_matches(h, '\\A(?:..)*?[89A-F].(?:..)*\\z') THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM f"""


def guessed_encodings(spark, sf_dir):
    """Contents that are no UTF-8, with the best guess."""
    f = table(spark, sf_dir, "source_files").select("path", "content").where(~E.is_utf8(F.col("content")) & E.bom(F.col("content")).isNull())
    g = spread(f).withColumn("d", E.heuristic(F.col("content")))
    one = g.select("path", F.sha2("content", 256).alias("sha"), "d.encoding", "d.confidence", E.to_text(F.col("content"), F.col("d.encoding")).contains("�").alias("lossy")).distinct()
    return one.groupBy("encoding").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum(F.col("lossy").cast("long")).alias("lossy"))


_CUSTOM = [
    {"name": "todo", "regex": r"TODO:[ \t]*([^\r\n]+)", "group": 1, "extensions": ["py", "rs"], "category": "note"},
    {"name": "quoted", "regex": r'"([^"\r\n]*)"', "group": 1, "extensions": ["*"], "category": "string"},
]


def custom_patterns(spark, sf_dir):
    """User patterns with their places, in contents that its SQL can decode."""
    return _custom(sources(spark, sf_dir))


def custom_patterns_all(spark, sf_dir):
    """User patterns with their places, in all files of any encoding."""
    return _custom(texts(spark, sf_dir))


def _custom(files):
    m = X.custom_matches(files, _CUSTOM)
    return m.select("path", "pattern_name", "category", F.col("idx").cast("long").alias("idx"), "raw_match", "content", F.col("start.line").cast("long").alias("line"), F.col("start.column").cast("long").alias("col"), F.col("start.offset").cast("long").alias("at")).distinct()


def _custom_sql(p, where):
    e = p["regex"].replace("'", "''")
    return f"""SELECT path, '{p['name']}' AS pattern_name, '{p['category']}' AS category, i AS idx, a[i + 1] AS raw_match, coalesce(nullif(regexp_extract(a[i + 1], '{e}', 1), ''), a[i + 1]) AS content,
  substring(text, 1, coalesce(list_sum(list_transform(s[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(a[1:i], lambda x: length(x))), 0)::BIGINT) AS pre
  FROM (SELECT path, text, regexp_extract_all(text, '{e}', 0) AS a, regexp_split_to_array(text, '{e}') AS s FROM f WHERE {where}), LATERAL (SELECT unnest(range(len(a)))) u(i)"""


CUSTOM_PATTERNS = f"""WITH f AS {_TEXT}, m AS ({_custom_sql(_CUSTOM[0], "ext IN ('py', 'rs')")} UNION ALL {_custom_sql(_CUSTOM[1], "ext NOT IN ('py', 'rs')")})
SELECT DISTINCT path, pattern_name, category, idx, raw_match, content, 1 + length(pre) - length(replace(pre, chr(10), '')) AS line, strlen(string_split(pre, chr(10))[-1]) + 1 AS col, strlen(pre) AS at FROM m"""


def summaries(spark, sf_dir):
    """Totals of the matches by four groups in one pass."""
    m = table(spark, sf_dir, "verify_matches").select("match_id", "path", "pattern_name", "pattern_type", F.lower("category").alias("category")).distinct()
    m = m.withColumn("file_type", C.extension(F.col("path")))
    names = ["pattern_name", "category", "file_type", "pattern_type"]
    g = m.groupingSets([[F.col(n)] for n in names] + [[]], *map(F.col, names)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    return g.select(*names, F.col("gid").cast("long").alias("gid"), "n")


SUMMARIES = r"""SELECT pattern_name, category, file_type, pattern_type, grouping_id(pattern_name, category, file_type, pattern_type) AS gid, count(*) AS n FROM
  (SELECT DISTINCT match_id, path, pattern_name, pattern_type, lower(category) AS category, regexp_extract(path, '\.([^./]+)$', 1) AS file_type FROM verify_matches)
  GROUP BY GROUPING SETS ((pattern_name), (category), (file_type), (pattern_type), ())"""


def doc_lines(spark, sf_dir):
    """(doc_id, line, text): lines of the documents, without line ends and a final empty line."""
    from loomtext.operators.clean import lines

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line_text")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "line_text")


_DOC_LINES = r"""dl AS (SELECT doc_id, i + 1 AS line, a[i + 1] AS line_text FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM
  (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL)), LATERAL (SELECT unnest(range(len(a)))) u(i))"""


def segments(spark, sf_dir, script: str = "CJK", head: int | None = None):
    """Runs of lines that hold a script, with their first lines."""
    from loomtext.operators.windows import islands

    hit = doc_lines(spark, sf_dir).where(S.matches_script(F.col("line_text"), script))
    return islands(hit, ["doc_id"], "line", "line_text" if head else None, head)


def detect_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "start_line", "end_line", "n_lines")


_SEG = f"""WITH {_DOC_LINES}, h AS (SELECT * FROM dl WHERE regexp_matches(line_text, '[{S.WIDE_CJK}]')), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM h),
s AS (SELECT doc_id, k, min(line) AS start_line, max(line) AS end_line, count(*) AS n_lines, list(line_text ORDER BY line) AS texts FROM g GROUP BY doc_id, k)"""
DETECT_SEGMENTS = _SEG + " SELECT doc_id, start_line, end_line, n_lines FROM s"


def segment_preview(spark, sf_dir):
    """First three lines of each segment, and how many more there are."""
    s = segments(spark, sf_dir, head=3)
    more = F.col("n_lines") - 3
    return s.select("doc_id", "start_line", F.array_join(F.transform(F.slice("texts", 1, 3), lambda x: C.cut_with_dots(x, 80)), "\n").alias("preview"), F.when(more > 0, F.concat(more.cast("string"), F.lit(" more lines"))).otherwise("").alias("rest"))


SEGMENT_PREVIEW = _SEG + " SELECT doc_id, start_line, array_to_string(list_transform(texts[1:3], lambda x: CASE WHEN length(x) > 80 THEN left(x, 80) || '...' ELSE x END), chr(10)) AS preview, CASE WHEN n_lines > 3 THEN (n_lines - 3) || ' more lines' ELSE '' END AS rest FROM s"


def detect_totals(spark, sf_dir):
    """Totals of the detection per script."""
    d = doc_lines(spark, sf_dir)
    return d.agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("lines"), *[F.sum(S.matches_script(F.col("line_text"), k).cast("long")).alias(k.lower() + "_lines") for k in S.DETECT])


DETECT_TOTALS = f"WITH {_DOC_LINES} SELECT count(DISTINCT doc_id) AS files, count(*) AS lines, " + ", ".join(f"sum(regexp_matches(line_text, '[{r}]')::BIGINT)::BIGINT AS {k.lower()}_lines" for k, r in S.DETECT.items()) + " FROM dl"


def cjk_lines(spark, sf_dir):
    """Lines with CJK and their distinct characters."""
    d = doc_lines(spark, sf_dir)
    chars = F.array_sort(F.array_distinct(F.regexp_extract_all("line_text", F.lit(f"[{S.CJK}]"), F.lit(0))))
    return d.where(S.has(F.col("line_text"), S.CJK)).select("doc_id", "line", F.array_join(chars, "").alias("chars"), F.size(chars).cast("long").alias("n_chars"))


CJK_LINES = f"WITH {_DOC_LINES} SELECT doc_id, line, array_to_string(list_sort(list_distinct(regexp_extract_all(line_text, '[{S.CJK}]', 0))), '') AS chars, len(list_distinct(regexp_extract_all(line_text, '[{S.CJK}]', 0))) AS n_chars FROM dl WHERE regexp_matches(line_text, '[{S.CJK}]')"

QUERIES = {
    "lex_tokens": (lex_tokens, LEX_TOKENS),
    "lex_tokens_all": (lex_tokens_all, None),
    "lex_all": (lex_all, None),
    "lex_agree": (lex_agree, LEX_AGREE),
    "unit_counts": (unit_counts, None),
    "file_types": (file_types, FILE_TYPES),
    "all_extensions": (all_extensions, ALL_EXTENSIONS),
    "scanned_files": (scanned_files, SCANNED_FILES),
    "file_encodings": (file_encodings, FILE_ENCODINGS),
    "guessed_encodings": (guessed_encodings, None),
    "custom_patterns": (custom_patterns, CUSTOM_PATTERNS),
    "custom_patterns_all": (custom_patterns_all, None),
    "summaries": (summaries, SUMMARIES),
    "detect_segments": (detect_segments, DETECT_SEGMENTS),
    "segment_preview": (segment_preview, SEGMENT_PREVIEW),
    "detect_totals": (detect_totals, DETECT_TOTALS),
    "cjk_lines": (cjk_lines, CJK_LINES),
}
