"""Queries over scalar functions, cleaning and placeholders, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import scalars as C
from loomtext.functions.scripts import TOKEN_CJK, WS
from loomtext.operators import clean as K
from loomtext.plans.q_text import TEXTS_SQL, texts
from loomtext.session import table

_CJKN = f"len(regexp_extract_all(text, '[{TOKEN_CJK}]'))"


def token_estimates(spark, sf_dir):
    """C13, C14, C15, C16, C18, C22."""
    t, c, n = texts(spark, sf_dir), F.col("text"), F.length("text")
    return t.select(
        "id", C.estimate_tokens(c).alias("tokens"), C.estimate_tokens(c, "conservative").alias("tokens_safe"), C.max_chars(n * 10, "conservative").alias("max_chars"),
        C.chars_to_tokens(n).alias("as_tokens"), C.tokens_to_chars(n).alias("as_chars"), C.split_limit(n).alias("split_at"), C.input_limit(n - 100).alias("input_limit"),
        C.fits(c, F.lit(300)).alias("fits"), C.fits_tokens(c, 250).alias("fits_tokens"), C.has_braces(c).alias("braces"),
    )


TOKEN_ESTIMATES = f"""WITH {TEXTS_SQL} SELECT id, ceil({_CJKN} / 1.5::DOUBLE + (length(text) - {_CJKN}) / 4.0::DOUBLE)::BIGINT + 150 AS tokens,
  ceil({_CJKN} / 1.5::DOUBLE + (length(text) - {_CJKN}) / 3.5::DOUBLE)::BIGINT + 180 AS tokens_safe, floor(greatest(floor(length(text) * 10 * 0.5::DOUBLE) - 180, 0) * 1.5)::BIGINT AS max_chars,
  ceil(length(text) / 1.5::DOUBLE)::BIGINT AS as_tokens, floor(length(text) * 1.5)::BIGINT AS as_chars, (length(text) * 4 // 5)::BIGINT AS split_at,
  CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 100 THEN 4000 ELSE floor(floor((length(text) - 100) * 0.7::DOUBLE) * 1.5) END::BIGINT AS input_limit,
  strlen(text) <= 300 AS fits, ceil({_CJKN} / 1.5::DOUBLE + (length(text) - {_CJKN}) / 4.0::DOUBLE)::BIGINT + 150 <= 250 AS fits_tokens, contains(text, '{{') AND contains(text, '}}') AS braces FROM texts"""


def split_texts(spark, sf_dir):
    """Pieces of 400 characters."""
    return texts(spark, sf_dir).select("id", F.posexplode(C.split_chars(F.col("text"), 400)).alias("pos", "piece")).select("id", F.col("pos").cast("long").alias("pos"), "piece")


SPLIT_TEXTS = f"WITH {TEXTS_SQL}, p AS (SELECT id, text, unnest(range((length(text) + 399) // 400)) AS pos FROM texts) SELECT id, pos, substring(text, pos * 400 + 1, 400) AS piece FROM p"


def shortened(spark, sf_dir):
    """L5, L4, C46, C47, X44."""
    m = table(spark, sf_dir, "verify_matches").select("path", "extracted_text").distinct()
    c = F.col("extracted_text")
    return m.select("path", "extracted_text", C.shorten(c, 40).alias("short"), C.cut_with_dots(c, 40).alias("cut"), C.base_name(F.col("path")).alias("name"), C.extension(F.col("path")).alias("ext"))


SHORTENED = """SELECT DISTINCT path, extracted_text, CASE WHEN length(extracted_text) > 40 THEN left(extracted_text, 37) || '...' ELSE extracted_text END AS short,
  CASE WHEN length(extracted_text) > 40 THEN left(extracted_text, 40) || '...' ELSE extracted_text END AS "cut",
  string_split(path, '/')[-1] AS name, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM verify_matches"""

_KEYS = ["xxx", "Your-API-Key", "${KEY}", "sk-abcdefghijklmnopqrstuvwx", "", "real-key-1", "TEST", "none"]


def api_keys(spark, sf_dir):
    """C25, C47, T17, T20."""
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(_KEYS)], "id int, k string")
    msg = F.concat(F.lit("failed: Bearer abc.def-1= with key "), F.col("k"), F.lit(" sk-0123456789abcdefghij."))
    return rows.select("id", C.valid_key(F.col("k")).alias("valid"), C.redact(msg, ("real-key-1",)).alias("message"), C.next_key(F.col("id"), ["a", "b", "c"]).alias("next_key"))


API_KEYS = f"""SELECT id, k <> '' AND NOT (starts_with(k, '${{') AND ends_with(k, '}}')) AND lower(k) NOT IN ({', '.join(map(repr, C.NO_KEYS))}) AS valid,
  regexp_replace(regexp_replace(replace('failed: Bearer abc.def-1= with key ' || k || ' sk-0123456789abcdefghij.', 'real-key-1', '***REDACTED***'), 'sk-[a-zA-Z0-9]{{20,}}', '***REDACTED***', 'g'), 'Bearer\\s+[a-zA-Z0-9\\-._~+/]+=*', '***REDACTED***', 'g') AS message,
  ['a', 'b', 'c'][id % 3 + 1] AS next_key FROM (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(_KEYS))}) v(id, k)"""


def retries(spark, sf_dir):
    """Delays and whether a failed call may be repeated."""
    rows = spark.range(0, 12).withColumn("kind", F.element_at(F.array(F.lit("http"), F.lit("translation"), F.lit("config")), (F.col("id") % 3 + 1).cast("int")))
    rows = rows.withColumn("message", F.when(F.col("id") < 6, "Timeout").otherwise("401 Unauthorized"))
    return rows.select("id", C.backoff_ms(F.col("id")).alias("delay_ms"), C.is_retryable(F.col("kind"), F.col("message")).alias("retry"))


RETRIES = """SELECT id, floor(least(100 * pow(2, id), 5000) * 1.1::DOUBLE + 1e-9)::BIGINT AS delay_ms,
  CASE id % 3 WHEN 0 THEN true WHEN 1 THEN id < 6 ELSE false END AS retry FROM range(12) r(id)"""


def reply_checks(spark, sf_dir):
    """Replies unwrapped and validated."""
    r = table(spark, sf_dir, "translate_responses").select("response_id", "original_text", "translated_text").distinct()
    t = F.col("translated_text")
    return r.select("response_id", C.unwrap_markdown(t).alias("body"), C.translation_issue(F.col("original_text"), t).alias("issue"))


_T = f"regexp_replace(translated_text, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"
_IN = f"regexp_extract({_T}, '\\A```(?:\\w*)\\n?(.*?)\\n?```\\z', 1, 's')"
_PHR = " OR ".join(f"(contains(lower(translated_text), '{p}') AND NOT contains(lower(original_text), '{p}'))" for p in C.PHRASES)
REPLY_CHECKS = f"""SELECT DISTINCT response_id, CASE WHEN regexp_matches({_T}, '\\A```(?:\\w*)\\n?(.*?)\\n?```\\z', 's') THEN regexp_replace({_IN}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')
  WHEN regexp_matches({_T}, '\\A`([^`]+)`\\z') THEN regexp_extract({_T}, '\\A`([^`]+)`\\z', 1) ELSE {_T} END AS body,
  CASE WHEN coalesce(length(translated_text), 0) = 0 THEN 'empty' WHEN coalesce(length(translated_text) / nullif(length(original_text), 0)::DOUBLE, 1.0) > 5.0 THEN 'too_long' WHEN {_PHR} THEN 'phrase' END AS issue FROM translate_responses"""


def prompts(spark, sf_dir):
    """Prompts, request bodies and the parts of replies."""
    q = table(spark, sf_dir, "translate_requests").where("text IS NOT NULL AND source_lang IS NOT NULL AND length(text) < 400").select("request_id", "text", "source_lang", "target_lang").distinct()
    p = C.user_prompt(F.col("text"), F.col("source_lang"), F.col("target_lang"))
    body = C.request_body("m", F.col("text"), F.col("source_lang"), F.col("target_lang"))
    fake = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return q.select("request_id", "source_lang", "text", p.alias("prompt"), F.get_json_object(body, "$.messages[1].content").alias("sent"), C.reply_text(fake).alias("reply"), C.reply_error(F.lit('{"error": {"message": "quota"}}')).alias("error"))


_PROMPT = "CASE WHEN upper(source_lang) = 'AUTO' THEN 'Auto-detect the source language and translate to ' || target_lang ELSE 'Translate from ' || source_lang || ' to ' || target_lang END || ':\n\n' || text"
PROMPTS = f"SELECT DISTINCT request_id, source_lang, text, {_PROMPT} AS prompt, {_PROMPT} AS sent, text AS reply, 'quota' AS error FROM translate_requests WHERE text IS NOT NULL AND source_lang IS NOT NULL AND length(text) < 400"


def hashes(spark, sf_dir):
    """C29, C30, C32, C33."""
    f = table(spark, sf_dir, "source_files").select("path", "content", "project_fingerprint", "length").distinct()
    return f.select(
        "path", C.sha256(F.col("content")).alias("sha"), C.project_fingerprint(F.col("path"), F.col("length")).alias("fingerprint"), C.project_id(F.col("project_fingerprint")).alias("project"),
        C.utc_date(F.col("length") * 100_000).alias("day"),
    )


HASHES = """SELECT DISTINCT path, sha256(content) AS sha, left(sha256(path || '|' || length), 16) AS fingerprint, left(sha256(project_fingerprint), 16) AS project,
  strftime(make_timestamp(length * 100000 * 1000000), '%Y-%m-%d') AS day FROM source_files"""

_CFG = {"source_langs": ["zh", "ja"], "target_lang": "en", "include": ["**/*.py"], "exclude": [], "max_length": 100000, "comments": True, "strings": False}


def config_hashes(spark, sf_dir):
    """Hash of a configuration, and variables expanded."""
    env = {"HOME_DIR": "/home/a", "HOME": "/h", "COST": "$5"}
    t = spark.createDataFrame([(1, "${HOME}/x"), (2, "$HOME_DIR/y"), (3, "$NONE and ${COST}"), (4, None)], "id int, t string")
    return t.select("id", C.expand_env(F.col("t"), env).alias("expanded"), C.config_hash(_CFG).alias("hash"))


CONFIG_HASHES = """SELECT id, replace(replace(replace(t, '${HOME}', '/h'), '$HOME_DIR', '/home/a'), '${COST}', '$5') AS expanded,
  left(sha256('source_langs:zh,ja,|target_lang:en|include:**/*.py,|exclude:|max_length:100000|comments:1|strings:0'), 16) AS hash
  FROM (VALUES (1, '${HOME}/x'), (2, '$HOME_DIR/y'), (3, '$NONE and ${COST}'), (4, NULL)) v(id, t)"""


def format_marks(spark, sf_dir):
    """Specifiers protected and restored."""
    m = table(spark, sf_dir, "verify_matches").where("extracted_text IS NOT NULL").select("extracted_text").distinct()
    c = F.col("extracted_text")
    out = m.select(c.alias("t"), *[C.protect(c, k).alias(k) for k in C.FORMATS])
    cols = [x for k in C.FORMATS for x in (F.col(k + ".text").alias(k), F.size(k + ".originals").cast("long").alias(k + "_n"), (C.restore(F.col(k + ".text"), F.col(k + ".originals"), k) == F.col("t")).alias(k + "_same"))]
    return out.select("t", *cols)


def _marks(p, mark):
    parts = f"regexp_split_to_array(extracted_text, '{p}')"
    return f"list_reduce(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x ELSE '{mark}' || (i - 2) || '__' || x END), lambda a, b: a || b)"


FORMAT_MARKS = "SELECT DISTINCT extracted_text AS t, " + ", ".join(
    f"{_marks(p, m)} AS {k}, len(regexp_extract_all(extracted_text, '{p}')) AS {k}_n, true AS {k}_same" for k, (p, m) in C.FORMATS.items()) + " FROM verify_matches WHERE extracted_text IS NOT NULL"


def marker_checks(spark, sf_dir):
    """Marks for spans, damaged marks, missing and unexpected ones."""
    t = spark.createDataFrame([(1, "String ${value} here", [(7, 15)]), (2, "${a} and ${b}", [(0, 4), (9, 13)]), (3, "none", [])], "id int, t string, spans array<struct<start: int, end: int>>")
    p = C.protect_spans(F.col("t"), F.col("spans"))
    reply = F.concat(F.lit("__PH_1__ __PH_7__ "), F.col("t"))
    done = C.apply_regions(F.col("t"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("X").alias("text"))))
    return t.select(
        "id", p.alias("protected"), F.array_join(C.missing_markers(p, reply).cast("array<string>"), ",").alias("missing"), F.array_join(C.unexpected_markers(p, reply).cast("array<string>"), ",").alias("unexpected"),
        F.array_join(C.marker_variants(F.col("id")), "|").alias("variants"), C.restore_spans(p, F.transform("spans", lambda s: F.lit("V"))).alias("restored"), done.alias("replaced"),
    )


MARKER_CHECKS = """SELECT * FROM (VALUES (1, 'String __PH_0__ here', '0', '1,7', '__PH_1|1__|__PH1__|__PH1_', 'String V here', 'String X here'),
  (2, '__PH_0__ and __PH_1__', '0', '7', '__PH_2|2__|__PH2__|__PH2_', 'V and V', 'X and X'), (3, 'none', '', '1,7', '__PH_3|3__|__PH3__|__PH3_', 'none', 'none'))
  v(id, protected, missing, unexpected, variants, restored, replaced)"""


def byte_positions(spark, sf_dir):
    """Places in documents by byte offset."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) BETWEEN 20 AND 3000").select("doc_id", "text")
    n = F.octet_length(F.left("text", F.lit(17)))
    pre = C.byte_prefix(F.col("text"), n)
    return d.select(
        "doc_id", n.cast("long").alias("offset"), C.line_of(pre).cast("long").alias("line"), C.column_of(pre).cast("long").alias("col"), C.byte_to_char(F.col("text"), n).cast("long").alias("chars"),
        C.byte_slice(F.col("text"), n, n + F.octet_length(F.substring("text", 18, 2))).alias("part"), C.within(n, F.lit(17), F.lit(20)).alias("within"), C.distance(n, F.lit(20)).cast("long").alias("rest"),
    )


BYTE_POSITIONS = """SELECT doc_id, strlen(left(text, 17)) AS "offset", 1 + length(left(text, 17)) - length(replace(left(text, 17), chr(10), '')) AS line,
  strlen(string_split(left(text, 17), chr(10))[-1]) + 1 AS col, 17::BIGINT AS chars, substring(text, 18, 2) AS part,
  strlen(left(text, 17)) BETWEEN 17 AND 20 AS "within", greatest(20 - strlen(left(text, 17)), 0) AS rest FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 20 AND 3000"""


def clean_comments(spark, sf_dir):
    """Comment marks taken off the matches."""
    m = table(spark, sf_dir, "verify_matches").where("raw_match IS NOT NULL AND pattern_name IN ('comment', 'doc_string')").select("raw_match").distinct()
    c = F.col("raw_match")
    kind = F.when(c.startswith("/**") | c.startswith("///"), "doc").when(c.startswith("/*"), "block").otherwise("line")
    return m.select("raw_match", kind.alias("kind"), K.comment(c, kind).alias("cleaned"), C.comment_prefix(c).alias("prefix"), C.comment_kind(c).alias("mark"))


def _rt(e):
    return f"regexp_replace({e}, '[{WS}]+\\z', '')"


def _unstar(e):
    return _rt(f"regexp_replace(regexp_replace({e}, '\\r\\n', chr(10), 'g'), '(?m)^[{WS}]*(?:\\*[{WS}]*)?', '', 'g')")


_RAW = "raw_match"
_LINES = r"list_filter(string_split(replace(raw_match, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_matches(x, '^\s*///'))"
CLEAN_COMMENTS = rf"""WITH m AS (SELECT DISTINCT raw_match FROM verify_matches WHERE raw_match IS NOT NULL AND pattern_name IN ('comment', 'doc_string')),
k AS (SELECT *, CASE WHEN starts_with(raw_match, '/**') OR starts_with(raw_match, '///') THEN 'doc' WHEN starts_with(raw_match, '/*') THEN 'block' ELSE 'line' END AS kind,
  regexp_extract(raw_match, '\A[{WS}]*(///|//!|//|/\*\*|/\*|\*|#)', 1) AS mk, regexp_extract(raw_match, '\A([{WS}]*)', 1) AS ind FROM m)
SELECT raw_match, kind, CASE kind WHEN 'line' THEN regexp_replace(regexp_replace(raw_match, '\A[{WS}]+|[{WS}]+\z', '', 'g'), '\A(?:#|//)[{WS}]*', '')
  ELSE cl.cleaned END AS cleaned, CASE WHEN mk <> '' THEN ind || mk || ' ' ELSE ind END AS prefix,
  CASE mk WHEN '///' THEN 'doc' WHEN '//!' THEN 'module_doc' WHEN '//' THEN 'line' WHEN '/**' THEN 'block_doc' WHEN '/*' THEN 'block' WHEN '*' THEN 'star' WHEN '#' THEN 'hash' ELSE 'none' END AS mark
FROM k, LATERAL (SELECT CASE WHEN kind = 'doc' AND starts_with(raw_match, '///') THEN array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '^\s*///[{WS}]*', '')), chr(10))
  WHEN kind = 'doc' THEN array_to_string(list_transform(string_split(replace(string_split(substring(raw_match, 4), '*/')[1], chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '\A[{WS}]*(?:\*[{WS}]*)?', '')), chr(10))
  WHEN kind = 'block' THEN array_to_string(list_transform(string_split(replace(regexp_replace(string_split(substring(raw_match, 3), '*/')[1], '\A[{WS}]+|[{WS}]+\z', '', 'g'), chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '\A[{WS}]*(?:\*[{WS}]*)?', '')), chr(10)) END AS raw) q,
  LATERAL (SELECT CASE WHEN kind = 'doc' AND starts_with(raw_match, '///') THEN q.raw ELSE regexp_replace(q.raw, '[{WS}]+\z', '') END AS cleaned) cl"""

_LITS = ['"a"', "'b c'", '`x`', 'r"raw"', 'r#"hello "world""#', 'b"by"', 'f"fs"', '""q""', "plain", "[sq]", "(rd)", "{cu}", '"']


def clean_literals(spark, sf_dir):
    """Quotes, prefixes and brackets taken off literals."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(_LITS)], "id int, t string")
    c = F.col("t")
    return rows.select("id", K.string_body(c).alias("body"), K.quotes(c).alias("unquoted"), K.brackets(c, "square").alias("square"), K.extract(c, {"type": "regex", "pattern": "([a-z]+) ([a-z]+)", "group": 2}).alias("second"))


CLEAN_LITERALS = r"""SELECT id, CASE WHEN regexp_matches(t, '\A`(.*)`\z') THEN regexp_extract(t, '\A`(.*)`\z', 1) WHEN regexp_matches(t, '\Ar#*"') THEN regexp_replace(regexp_replace(t, '\Ar#*"', ''), '"#*\z', '')
  WHEN regexp_matches(t, '\A[bf]"') THEN substring(t, 3, length(t) - 3) WHEN regexp_matches(t, '\A''(.*)''\z') THEN substring(t, 2, length(t) - 2) ELSE regexp_replace(t, '\A"+|"+\z', '', 'g') END AS body,
  CASE WHEN length(t) > 1 AND (regexp_matches(t, '\A".*"\z') OR regexp_matches(t, '\A''.*''\z')) THEN substring(t, 2, length(t) - 2) ELSE t END AS unquoted,
  CASE WHEN regexp_matches(t, '\A\[.*\]\z') THEN substring(t, 2, length(t) - 2) ELSE t END AS square, CASE WHEN regexp_matches(t, '([a-z]+) ([a-z]+)') THEN regexp_extract(t, '([a-z]+) ([a-z]+)', 2) ELSE t END AS second
  FROM (VALUES """ + ", ".join("(%d, '%s')" % (i, x.replace("'", "''")) for i, x in enumerate(_LITS)) + ") v(id, t)"

QUERIES = {
    "token_estimates": (token_estimates, TOKEN_ESTIMATES),
    "split_texts": (split_texts, SPLIT_TEXTS),
    "shortened": (shortened, SHORTENED),
    "api_keys": (api_keys, API_KEYS),
    "retries": (retries, RETRIES),
    "reply_checks": (reply_checks, REPLY_CHECKS),
    "prompts": (prompts, PROMPTS),
    "hashes": (hashes, HASHES),
    "config_hashes": (config_hashes, CONFIG_HASHES),
    "format_marks": (format_marks, FORMAT_MARKS),
    "marker_checks": (marker_checks, MARKER_CHECKS),
    "byte_positions": (byte_positions, BYTE_POSITIONS),
    "clean_comments": (clean_comments, CLEAN_COMMENTS),
    "clean_literals": (clean_literals, CLEAN_LITERALS),
}
