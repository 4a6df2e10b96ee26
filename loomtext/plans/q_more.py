"""Further queries with SQL of their own: lexing by file type, kinds of regions, line ends, limits, retries, placeholders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import scalars as C
from loomtext.operators import lexer as X
from loomtext.operators import routing as T
from loomtext.operators import stats as A
from loomtext.operators import translate as P
from loomtext.operators import writer as W
from loomtext.plans import q_code, q_rel
from loomtext.session import spread, table

# Patterns written for the SQL side alone, in RE2; nested template strings, which it cannot know, aren't in the tables.
_D, _S = r'"(?:[^"\\\r\n]|\\(?s:.)|\\\z)*(?:"|\z)', r"'(?:[^'\\\r\n]|\\(?s:.)|\\\z)*(?:'|\z)"
_BLOCK, _DOC, _LINE = r"/\*(?s:.*?)\*/", r"/\*\*(?s:.*?)\*/", r"//[^\r\n]*"
_TICK = r"`(?:[^`\\]|\\(?s:.))*(?:`|\z)"
_LANGS = {
    "py": [r'"""(?s:.*?)"""', r"'''(?s:.*?)'''", r"#[^\r\n]*", _D, _S],
    "js": [_DOC, _BLOCK, _LINE, _TICK, _D, _S],
    "ts": [_DOC, _BLOCK, _LINE, _TICK, _D, _S],
    "rs": [_DOC, _BLOCK, _LINE, r'r#"(?s:.*?)"#', _D],
    "go": [_BLOCK, _LINE, _TICK, _D, _S],
    "java": [_DOC, _BLOCK, _LINE, _D],
    "cs": [_BLOCK, _LINE, _D, _S],
    "php": [_DOC, _BLOCK, _LINE, r"#[^\r\n]*", _D, _S],
    "lua": [r"--\[\[(?s:.*?)\]\]", r"--[^\r\n]*", r"\[\[(?s:.*?)\[\[", r"\]\](?s:.*?)\]\]", _D, _S],
}
_CASES = " ".join("WHEN '{}' THEN {{f}}(text, '{}'{{a}})".format(e, "|".join(p).replace("'", "''")) for e, p in _LANGS.items())
_FOUND = f"""f AS {q_code._TEXT}, s AS (SELECT path, ext, CASE ext {_CASES.format(f='regexp_extract_all', a=', 0')} END AS a, CASE ext {_CASES.format(f='regexp_split_to_array', a='')} END AS s FROM f WHERE ext IN ({', '.join(map(repr, _LANGS))})),
t AS (SELECT path, ext, i AS idx, a[i + 1] AS raw, 1 + coalesce(list_sum(list_transform(s[1:i + 1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) + coalesce(list_sum(list_transform(a[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS line
  FROM s, LATERAL (SELECT unnest(range(len(a)))) u(i)),
k AS (SELECT *, CASE WHEN ext = 'py' AND (starts_with(raw, repeat('"', 3)) OR starts_with(raw, repeat('''', 3))) THEN 'doc_comment'
  WHEN ext IN ('js', 'ts', 'rs', 'java', 'php') AND starts_with(raw, '/**') THEN 'doc_comment' WHEN ext IN ('js', 'ts', 'rs', 'cs') AND starts_with(raw, '///') THEN 'doc_comment' WHEN ext = 'lua' AND starts_with(raw, '---') THEN 'doc_comment'
  WHEN ext = 'lua' AND starts_with(raw, '--[[') THEN 'block_comment' WHEN ext <> 'py' AND starts_with(raw, '/*') THEN 'block_comment'
  WHEN ext IN ('py', 'php') AND starts_with(raw, '#') THEN 'line_comment' WHEN ext = 'lua' AND starts_with(raw, '--') THEN 'line_comment' WHEN ext NOT IN ('py', 'lua') AND starts_with(raw, '//') THEN 'line_comment'
  WHEN ext = 'rs' AND starts_with(raw, 'r#') THEN 'raw_string' WHEN ext = 'lua' AND (starts_with(raw, '[[') OR starts_with(raw, ']]')) THEN 'multiline_string' WHEN starts_with(raw, '`') THEN 'template_string' ELSE 'string_literal' END AS kind FROM t)"""


def _languages(spark, sf_dir):
    return q_code.sources(spark, sf_dir).where(F.col("ext").isin(list(_LANGS)))


def lex_languages(spark, sf_dir):
    """Regions of nine languages with kinds and lines, in contents that SQL can decode."""
    r = X.lexed(spread(_languages(spark, sf_dir)))
    return r.select("path", "ext", F.col("idx").cast("long").alias("idx"), "kind", F.col("raw_match").alias("raw"), F.col("start.line").cast("long").alias("line")).distinct()


LEX_LANGUAGES = f"WITH {_FOUND} SELECT DISTINCT path, ext, idx, kind, raw, line::BIGINT AS line FROM k"


def region_nodes(spark, sf_dir):
    """Regions of the nine languages that are to be extracted, without doc comments, as matches."""
    r = X.lexed(spread(_languages(spark, sf_dir)), places=False)
    kind, c = F.col("kind"), F.col("content")
    u = r.where(X.should_extract(kind, c, 3, 60, docs=False)).withColumn("node_type", X.node_type(kind)).withColumn("pattern_name", F.lit(None).cast("string")).withColumn("pattern_type", F.lit(None).cast("string"))
    m = X.verify_matches(u, "ext", "idx")
    return m.select("path", "ext", F.col("idx").cast("long").alias("idx"), "pattern_name", "pattern_type", "category", "extracted_text").distinct()


REGION_NODES = f"""WITH {_FOUND}, c AS (SELECT path, ext, idx, kind, CASE kind WHEN 'line_comment' THEN regexp_replace(raw, '\\A(?:#|--|//) ?', '')
  WHEN 'block_comment' THEN regexp_replace(regexp_replace(raw, '\\A(?:/\\*|--\\[\\[) ?', ''), ' ?(?:\\*/|\\]\\])\\z', '') WHEN 'raw_string' THEN substring(raw, 4, length(raw) - 5)
  WHEN 'multiline_string' THEN substring(raw, 3, length(raw) - 4) ELSE substring(raw, 2, greatest(0, length(raw) - 2)) END AS content FROM k WHERE kind <> 'doc_comment')
SELECT DISTINCT path, ext, idx, CASE WHEN kind IN ('line_comment', 'block_comment') THEN 'comment' ELSE 'string_literal' END AS pattern_name, 'Builtin' AS pattern_type,
  CASE WHEN kind IN ('line_comment', 'block_comment') THEN 'other' ELSE 'string' END AS category, content AS extracted_text FROM c WHERE strlen(content) BETWEEN 3 AND 60"""


def line_endings(spark, sf_dir):
    """Line ends of the documents, and their texts with either kind."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    c = F.col("text")
    e = C.line_ending(c)
    return d.select("doc_id", (e == "\r\n").alias("crlf"), F.octet_length(C.with_line_ending(c, F.lit("\n"))).cast("long").alias("lf_bytes"), F.octet_length(C.with_line_ending(c, F.lit("\r\n"))).cast("long").alias("crlf_bytes"), (C.with_line_ending(C.with_line_ending(c, F.lit("\n")), e) == c).alias("back"))


LINE_ENDINGS = """WITH d AS (SELECT doc_id, text, replace(text, chr(13) || chr(10), chr(10)) AS lf FROM documents WHERE text IS NOT NULL)
SELECT doc_id, contains(text, chr(13) || chr(10)) AS crlf, strlen(lf) AS lf_bytes, strlen(lf) + length(lf) - length(replace(lf, chr(10), '')) AS crlf_bytes,
  CASE WHEN contains(text, chr(13) || chr(10)) THEN replace(lf, chr(10), chr(13) || chr(10)) ELSE lf END = text AS back FROM d"""


def provider_limits(spark, sf_dir):
    """Limits of the configurations' providers, and the length of a split piece."""
    known = F.create_map(*[x for k, (rate, most, piece) in C.PROVIDER_LIMITS.items() for x in (F.lit(k), F.struct(F.lit(rate).alias("rate"), F.lit(most).alias("most"), F.lit(piece).alias("piece")))])
    c = table(spark, sf_dir, "translate_configs").select("config_hash", F.lower("provider").alias("provider"))
    own = known[F.col("provider")]
    return c.select("config_hash", own["rate"].cast("long").alias("rate"), own["most"].cast("long").alias("most"), own["piece"].cast("long").alias("piece"), C.split_limit(own["most"]).alias("four_fifths"))


PROVIDER_LIMITS = """SELECT config_hash, l.rate::BIGINT AS rate, l.most::BIGINT AS most, l.piece::BIGINT AS piece, (l.most * 4 // 5)::BIGINT AS four_fifths
FROM translate_configs c LEFT JOIN (VALUES ('deeplx', 10, 5000, 4000), ('tencent', 20, 6000, 5000)) l(provider, rate, most, piece) ON lower(c.provider) = l.provider"""


def restored_spans(spark, sf_dir):
    """Two spans of every document marked and restored, also from damaged marks; variables in maps."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 8 AND NOT contains(text, '__')").select("doc_id", "source", "text")
    c = F.col("text")
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    p = C.protect_spans(c, F.array(span(0, 2), span(5, 7)))
    own = F.array(F.substring(c, 1, 2), F.substring(c, 6, 2))
    bad = F.replace(p, F.lit("__PH_1__"), F.lit("__PH_1"))
    env = C.expand_env_map(F.create_map(F.lit("a"), F.concat(F.lit("${ROOT}/"), F.coalesce("source", F.lit("-")))), {"ROOT": "/data"})
    return d.select("doc_id", p.alias("marked"), (C.restore_spans(p, own) == c).alias("restored"), (C.restore_spans(bad, own) == c).alias("mended"), F.array_join(C.missing_markers(p, bad).cast("array<string>"), ",").alias("missing"), F.array_join(C.markers(p).cast("array<string>"), ",").alias("marks"), env["a"].alias("place"))


RESTORED_SPANS = """SELECT doc_id, '__PH_0__' || substring(text, 3, 3) || '__PH_1__' || substring(text, 8) AS marked, true AS restored, true AS mended, '1' AS missing, '0,1' AS marks, '/data/' || coalesce(source, '-') AS place
FROM documents WHERE length(text) >= 8 AND NOT contains(text, '__')"""


def diffs(spark, sf_dir):
    """Changes of each file as a text, of the matches that hold blanks."""
    m = table(spark, sf_dir, "verify_matches").where("path IS NOT NULL AND extracted_text IS NOT NULL").select("path", F.col("position.offset").alias("start"), F.col("extracted_text").alias("before"), F.replace("extracted_text", F.lit(" "), F.lit("_")).alias("after")).distinct()
    changed = W.preview(m.withColumn("changed", F.col("before") != F.col("after")).withColumnRenamed("path", "file").withColumn("path", F.struct("file", "start")))
    changed = changed.select("path.file", "path.start", F.col("before").alias("old"), F.col("after").alias("new"))
    return changed.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"), F.md5(C.unified_diff(F.collect_list(F.struct("start", "old", "new")))).alias("diff"))


DIFFS = """WITH m AS (SELECT DISTINCT path, position.offset AS s, extracted_text AS o, replace(extracted_text, ' ', '_') AS n FROM verify_matches WHERE path IS NOT NULL AND extracted_text IS NOT NULL)
SELECT path, count(*) AS n, md5(string_agg('@@ ' || s || ' @@' || chr(10) || '-' || o || chr(10) || '+' || n, chr(10) ORDER BY s, o, n)) AS diff FROM m WHERE o <> n GROUP BY path"""

def applied_lines(spark, sf_dir):
    """Texts of one line put in the place of their matches, each between two other lines with CR LF."""
    m = table(spark, sf_dir, "verify_matches").where(r"raw_match IS NOT NULL AND match_id IS NOT NULL AND contains(raw_match, extracted_text) AND NOT contains(raw_match, '\n') AND NOT contains(raw_match, '\r') AND extracted_text <> ''")
    m = m.select("match_id", "extracted_text", "raw_match").distinct()
    key = F.concat_ws(":", "match_id", F.md5("extracted_text"), F.md5("raw_match"))
    files = m.select(key.alias("path"), F.concat(F.lit("first\r\n  "), "raw_match", F.lit(" end\r\nlast")).alias("text"))
    units = m.select(key.alias("path"), F.col("extracted_text").alias("content"), F.replace("extracted_text", F.lit(" "), F.lit("_")).alias("translated"), "raw_match", F.lit(2).alias("line"), F.lit(3).alias("column"))
    a = W.apply_units(spread(files), units)
    return a.select("path", "after", "changed", "error")


APPLIED_LINES = r"""WITH m AS (SELECT DISTINCT match_id, extracted_text AS e, raw_match AS r FROM verify_matches WHERE raw_match IS NOT NULL AND match_id IS NOT NULL AND contains(raw_match, extracted_text) AND NOT contains(raw_match, chr(10)) AND NOT contains(raw_match, chr(13)) AND extracted_text <> ''),
n AS (SELECT *, match_id || ':' || md5(e) || ':' || md5(r) AS path, left(r, instr(r, e) - 1) || replace(e, ' ', '_') || substring(r, instr(r, e) + length(e)) AS new FROM m)
SELECT path, 'first' || chr(13) || chr(10) || '  ' || new || ' end' || chr(13) || chr(10) || 'last' AS after, new <> r AS changed, NULL::VARCHAR AS error FROM n"""

class _Marking:
    """A provider that puts low lines for blanks; a strict one refuses texts with a sign."""

    def __init__(self, name: str, most: int = 0, refuses: str = ""):
        self.name, self.max_input_chars, self.refuses = name, most, refuses

    def translate(self, texts, source, target):
        if self.refuses and any(self.refuses in t for t in texts):
            raise P.TransportError("refused")
        return [t.replace(" ", "_") for t in texts]


def translated_texts(spark, sf_dir):
    """Requests through providers of which one refuses some texts and one takes short ones only; long texts in parts."""
    q = table(spark, sf_dir, "translate_requests").where("text IS NOT NULL AND request_id IS NOT NULL").groupBy("request_id").agg(F.min("text").alias("content"))
    q = q.withColumn("source_lang", F.lit("AUTO")).withColumn("target_lang", F.lit("EN"))

    def make():
        options = P.Options(batch_size=16, max_retries=3, split_above=1500, split_size=700)
        return P.Service([_Marking("strict", 0, "e"), _Marking("short", 300), _Marking("plain")], {"strict": 3, "short": 1, "plain": 1}, options)

    return P.translate(spread(q), make).select("request_id", "translated", "error")


TRANSLATED_TEXTS = "SELECT request_id, replace(min(text), ' ', '_') AS translated, NULL::VARCHAR AS error FROM translate_requests WHERE text IS NOT NULL AND request_id IS NOT NULL GROUP BY 1"

_IDS = ["deeplx", "llm", "tencent", "local"]


def failovers(spark, sf_dir):
    """Providers that are tried after the one of each failed response."""
    order = F.create_map(*[x for i in _IDS for x in (F.lit(i), F.lit(",".join(T.failover_order(_IDS, i, 2))))])
    r = table(spark, sf_dir, "translate_responses").where("NOT success").select("response_id", "provider").distinct()
    return r.select("response_id", F.coalesce(order[F.col("provider")], F.lit(",".join(T.failover_order(_IDS, "", 2)))).alias("next"))


FAILOVERS = f"SELECT DISTINCT response_id, array_to_string(list_filter({_IDS!r}, lambda x: x <> coalesce(provider, ''))[1:2], ',') AS next FROM translate_responses WHERE NOT success"


def file_results(spark, sf_dir):
    """Counters of the files by their cache entries and matches. A match without raw text counts as skipped, a file with
    a match without category as failed."""
    cached = q_rel._cache(spark, sf_dir).where("is_translated").select("file_hash").distinct().withColumn("cached", F.lit(True))
    m = table(spark, sf_dir, "verify_matches").where("path IS NOT NULL").groupBy("path", "match_id").agg(F.max(F.col("raw_match").isNotNull()).alias("raw"), F.min(F.col("category").isNotNull()).alias("named"))
    per = m.groupBy("path").agg(F.count("*").alias("units"), F.sum(F.col("raw").cast("long")).alias("translated"), F.sum((~F.col("raw")).cast("long")).alias("skipped"), (~F.min("named")).alias("failed"))
    f = q_rel._files(spark, sf_dir).join(cached, "file_hash", "left").join(per, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return A.file_counters(f.select("path", F.coalesce("cached", F.lit(False)).alias("cached"), zero("units"), zero("translated"), zero("skipped"), F.coalesce("failed", F.lit(False)).alias("failed")))


FILE_RESULTS = f"""WITH {q_rel._F}, m AS (SELECT path, match_id, bool_or(raw_match IS NOT NULL) AS raw, bool_and(category IS NOT NULL) AS named FROM verify_matches WHERE path IS NOT NULL GROUP BY 1, 2),
p AS (SELECT path, count(*) AS units, count(*) FILTER (raw) AS translated, count(*) FILTER (NOT raw) AS skipped, NOT bool_and(named) AS failed FROM m GROUP BY 1),
r AS (SELECT f.path, f.file_hash IN (SELECT file_hash FROM cache_entries WHERE is_translated) AS cached, coalesce(units, 0) AS units, coalesce(translated, 0) AS translated, coalesce(skipped, 0) AS skipped, coalesce(failed, false) AS failed FROM f LEFT JOIN p USING (path))
SELECT count(*) AS files, count(*) FILTER (NOT cached) AS processed, count(*) FILTER (cached OR (skipped > 0 AND translated = 0)) AS skipped_files, count(*) FILTER (cached) AS cache_hits, sum(units)::BIGINT AS units, sum(translated)::BIGINT AS translated, count(*) FILTER (failed) AS failed_files FROM r"""


def label_keys(spark, sf_dir):
    """Labels of requests taken as keys: which could be one; messages without the keys; keys in turn."""
    r = table(spark, sf_dir, "translate_requests").where("request_id IS NOT NULL").select("request_id", "source_lang", "config_hash").distinct()
    key = F.concat(F.lit("sk-"), "config_hash", F.lit("0123456789"))
    msg = F.concat(F.lit("call failed: Bearer "), "config_hash", F.lit(" then "), key, F.lit("."))
    return r.select("request_id", "source_lang", "config_hash", C.valid_key(F.col("source_lang")).alias("valid"), C.redact(msg, ()).alias("message"), C.next_key(F.col("request_id"), ["a", "b", "c"]).alias("next_key")).distinct()


LABEL_KEYS = """SELECT DISTINCT request_id, source_lang, config_hash, coalesce(source_lang <> '' AND lower(source_lang) NOT IN ('xxx', 'your-api-key', 'your_api_key', 'api-key-here', 'placeholder', 'test', 'example', 'null', 'undefined', 'none', 'empty', 'default') AND NOT (starts_with(source_lang, '${') AND ends_with(source_lang, '}')), false) AS valid,
  'call failed: ***REDACTED*** then ***REDACTED***.' AS message, ['a', 'b', 'c'][request_id % 3 + 1] AS next_key FROM translate_requests WHERE request_id IS NOT NULL"""


def response_retries(spark, sf_dir):
    """Delays after the attempts of each request, and whether its last outcome may be repeated."""
    r = table(spark, sf_dir, "translate_responses").where("request_id IS NOT NULL").select("request_id", "response_id", "success", "provider").distinct()
    n = r.groupBy("request_id").agg(F.countDistinct("response_id").alias("attempts"), F.min(F.coalesce("success", F.lit(False))).alias("ok"))
    kind = F.when(F.col("request_id") % 2 == 0, "translation").otherwise("http")
    return n.select("request_id", C.backoff_ms(F.col("attempts")).alias("delay_ms"), C.is_retryable(kind, F.when(F.col("ok"), "401 Unauthorized").otherwise("Timeout")).alias("retry"))


RESPONSE_RETRIES = """SELECT request_id, floor(least(100 * pow(2, count(DISTINCT response_id)), 5000) * 1.1::DOUBLE + 1e-9)::BIGINT AS delay_ms,
  request_id % 2 = 1 OR NOT bool_and(coalesce(success, false)) AS retry FROM translate_responses WHERE request_id IS NOT NULL GROUP BY 1"""


def turn_shares(spark, sf_dir):
    """Weighted turns over blocks of as many documents as the weights sum up to."""
    w = {"a": 5, "b": 1, "c": 2, "off": 0}
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).cast("long").alias("block"), T.weighted(F.col("doc_id"), w).alias("turn"))
    return d.groupBy("block").agg(F.count("*").alias("n"), *[F.sum((F.col("turn") == k).cast("long")).alias(k) for k in w]).where("n = 8")


TURN_SHARES = "SELECT doc_id // 8 AS block, count(*) AS n, 5::BIGINT AS a, 1::BIGINT AS b, 2::BIGINT AS c, 0::BIGINT AS off FROM documents GROUP BY 1 HAVING count(*) = 8"

QUERIES = {
    "lex_languages": (lex_languages, LEX_LANGUAGES), "region_nodes": (region_nodes, REGION_NODES), "line_endings": (line_endings, LINE_ENDINGS), "provider_limits": (provider_limits, PROVIDER_LIMITS),
    "restored_spans": (restored_spans, RESTORED_SPANS), "diffs": (diffs, DIFFS), "applied_lines": (applied_lines, APPLIED_LINES), "translated_texts": (translated_texts, TRANSLATED_TEXTS), "failovers": (failovers, FAILOVERS), "file_results": (file_results, FILE_RESULTS), "label_keys": (label_keys, LABEL_KEYS),
    "response_retries": (response_retries, RESPONSE_RETRIES), "turn_shares": (turn_shares, TURN_SHARES),
}
