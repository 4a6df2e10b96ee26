"""Queries over caches, calls, intervals, joins and routing, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import scalars as C
from loomtext.operators import routing as T
from loomtext.operators import stats as A
from loomtext.operators import windows as O
from loomtext.operators.lexer import merged_units
from loomtext.session import spread, table
from loomtext.streaming import streams as M
from loomtext.sources import cache_table as B

_CFG = "9818b580addbefc6"


def _files(spark, sf_dir):
    f = table(spark, sf_dir, "source_files").select("path", F.sha2("content", 256).alias("file_hash"), "mtime", "project_fingerprint", "scanned_at")
    f = f.groupBy("path").agg(F.max_by(F.struct("file_hash", "mtime", "project_fingerprint"), "scanned_at").alias("r"))
    return f.select("path", F.col("r.file_hash").alias("file_hash"), F.col("r.project_fingerprint").alias("project_fingerprint"), F.unix_seconds(F.col("r.mtime").cast("timestamp")).alias("mtime"))


def _cache(spark, sf_dir):
    return table(spark, sf_dir, "cache_entries").distinct()


def _configured(spark, sf_dir):
    """Files with the configuration of the newest cache entry of their project."""
    conf = table(spark, sf_dir, "translate_configs").groupBy("project_fingerprint").agg(F.min("config_hash").alias("config_hash"))
    return _files(spark, sf_dir).join(conf, "project_fingerprint")


_F = "f AS (SELECT path, sha256(arg_max(content, scanned_at)) AS file_hash, arg_max(project_fingerprint, scanned_at) AS project_fingerprint, epoch(arg_max(mtime, scanned_at))::BIGINT AS mtime FROM source_files GROUP BY path)"
_CF = _F + ", k AS (SELECT project_fingerprint, min(config_hash) AS config_hash FROM translate_configs GROUP BY 1), cf AS (SELECT * FROM f JOIN k USING (project_fingerprint)), c AS (SELECT DISTINCT * FROM cache_entries)"


def cache_hits(spark, sf_dir):
    """Files with the newest entry of the same hash, project and configuration."""
    j = B.lookup(_configured(spark, sf_dir), _cache(spark, sf_dir))
    return j.select("path", "cached_at", B.is_valid(F.col("cached_mtime"), F.col("mtime")).alias("same_mtime"), "cached_done")


CACHE_HITS = f"WITH {_CF} SELECT cf.path, created_at AS cached_at, last_modified = mtime AS same_mtime, is_translated AS cached_done FROM cf LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_hash, project_fingerprint, config_hash ORDER BY created_at DESC, path DESC, run_id DESC) = 1) c USING (file_hash, project_fingerprint, config_hash)"


def pending_files(spark, sf_dir):
    """Files without a valid entry."""
    return B.pending(_configured(spark, sf_dir), _cache(spark, sf_dir)).select("path", "file_hash")


PENDING_FILES = f"WITH {_CF} SELECT path, file_hash FROM cf WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.is_translated AND c.file_hash = cf.file_hash AND c.project_fingerprint = cf.project_fingerprint AND c.config_hash = cf.config_hash AND c.last_modified = cf.mtime)"


def orphan_entries(spark, sf_dir):
    """Entries of contents that no file has."""
    return B.orphans(_cache(spark, sf_dir), _files(spark, sf_dir)).select("file_hash", "path").distinct()


ORPHANS = f"WITH {_F} SELECT DISTINCT file_hash, path FROM cache_entries WHERE file_hash NOT IN (SELECT file_hash FROM f)"


def cache_latest(spark, sf_dir):
    """The cache after all upserts."""
    return B.latest(_cache(spark, sf_dir)).select("file_hash", "project_fingerprint", "config_hash", "created_at", "path")


CACHE_LATEST = "SELECT file_hash, project_fingerprint, config_hash, created_at, path FROM (SELECT DISTINCT * FROM cache_entries) QUALIFY row_number() OVER (PARTITION BY file_hash, project_fingerprint, config_hash ORDER BY created_at DESC, path DESC, run_id DESC) = 1"


def cache_stats(spark, sf_dir):
    """Size of the cache, and of what is left after an invalidation by age."""
    c = _cache(spark, sf_dir)
    old = B.filter_by_age(c, "created_at", 10, F.lit(1772000000))
    return B.stats(c).withColumn("part", F.lit("all")).unionByName(B.stats(old).withColumn("part", F.lit("old")))


CACHE_STATS = "SELECT 'all' AS part, count(*) AS entries, count(DISTINCT path) AS paths, sum(is_translated::BIGINT)::BIGINT AS translated FROM (SELECT DISTINCT * FROM cache_entries) UNION ALL SELECT 'old', count(*), count(DISTINCT path), sum(is_translated::BIGINT)::BIGINT FROM (SELECT DISTINCT * FROM cache_entries) WHERE created_at < 1772000000 - 864000"


def backups(spark, sf_dir):
    """Backup files by name and age."""
    f = _files(spark, sf_dir).select(F.concat("path", F.when(F.length("path") % 3 == 0, ".bak").when(F.length("path") % 3 == 1, "_1.bak.py").otherwise("")).alias("path"), "mtime")
    return B.filter_by_age(B.find_backups(f), "mtime", 20, F.lit(1774000000))


BACKUPS = f"WITH {_F} SELECT * FROM (SELECT path || CASE length(path) % 3 WHEN 0 THEN '.bak' WHEN 1 THEN '_1.bak.py' ELSE '' END AS path, mtime FROM f) WHERE regexp_matches(path, '\\.bak(\\.[^./]+)?$') AND mtime < 1774000000 - 20 * 86400"


def _calls(spark, sf_dir):
    r = table(spark, sf_dir, "translate_responses").select("response_id", "provider", "latency_ms", "success", F.length("original_text").alias("chars"), "ts").distinct()
    return r.withColumn("success", F.coalesce("success", F.lit(False)))


_CALLS = "c AS (SELECT DISTINCT response_id, provider, latency_ms, coalesce(success, false) AS success, length(original_text) AS chars, ts FROM translate_responses)"
_STATS = """count(*) AS total_calls, sum(success::BIGINT)::BIGINT AS successes, sum((NOT success)::BIGINT)::BIGINT AS failures, count(latency_ms) FILTER (success) AS timed_calls, sum(coalesce(chars, 0))::BIGINT AS total_chars,
  round(coalesce(avg(latency_ms) FILTER (success), 0.0), 6) AS avg_latency, min(latency_ms) FILTER (success) AS min_latency, max(latency_ms) FILTER (success) AS max_latency, max(ts) AS last_call"""


def provider_stats(spark, sf_dir):
    """Calls, latencies and rates by provider."""
    return A.call_stats(_calls(spark, sf_dir), ["provider"])


PROVIDER_STATS = f"WITH {_CALLS} SELECT provider, {_STATS}, round(100.0 * sum((NOT success)::BIGINT) / count(*), 6) AS error_rate, round(100.0 * sum(success::BIGINT) / count(*), 6) AS success_rate FROM c GROUP BY provider"


def merged_stats(spark, sf_dir):
    """A2: statistics by day merged into those of the whole."""
    daily = A.call_stats(_calls(spark, sf_dir).withColumn("day", F.col("ts").cast("date")), ["provider", "day"])
    return A.merge_stats(daily, ["provider"])


MERGED_STATS = f"WITH {_CALLS} SELECT provider, {_STATS.replace('6) AS avg', '4) AS avg')} FROM c GROUP BY provider"


def run_counters(spark, sf_dir):
    """Counters of file results."""
    f = _files(spark, sf_dir)
    n = F.length("path")
    r = f.select("path", (n % 3 == 0).alias("cached"), n.cast("long").alias("units"), F.when(n % 4 == 0, 0).otherwise(n - 3).cast("long").alias("translated"), (n % 5).cast("long").alias("skipped"), (n % 7 == 0).alias("failed"))
    return A.file_counters(r)


RUN_COUNTERS = f"WITH {_F}, r AS (SELECT length(path) AS n FROM f) SELECT count(*) AS files, sum((n % 3 <> 0)::BIGINT)::BIGINT AS processed, sum((n % 3 = 0 OR (n % 5 > 0 AND n % 4 = 0))::BIGINT)::BIGINT AS skipped_files, sum((n % 3 = 0)::BIGINT)::BIGINT AS cache_hits, sum(n)::BIGINT AS units, sum(CASE WHEN n % 4 = 0 THEN 0 ELSE n - 3 END)::BIGINT AS translated, sum((n % 7 = 0)::BIGINT)::BIGINT AS failed_files FROM r"


def run_reports(spark, sf_dir):
    """Durations, speeds and rates of the runs."""
    c = _cache(spark, sf_dir).groupBy("run_id").agg(F.sum(F.col("is_translated").cast("long")).alias("done"), F.count("*").alias("n"))
    r = table(spark, sf_dir, "scan_runs").join(c, "run_id", "left")
    rep = A.run_report(F.col("started_at"), F.coalesce("finished_at", "started_at"), F.coalesce("done", F.lit(0)), F.coalesce("n", F.lit(0)), F.coalesce("done", F.lit(0)), F.coalesce(F.col("n") - F.col("done"), F.lit(0)))
    return r.select("run_id", rep.alias("r")).select("run_id", "r.*")


RUN_REPORTS = """WITH c AS (SELECT run_id, sum(is_translated::BIGINT)::BIGINT AS done, count(*) AS n FROM (SELECT DISTINCT * FROM cache_entries) GROUP BY 1),
r AS (SELECT s.run_id, coalesce(done, 0) AS done, coalesce(n, 0) AS n, epoch_ms(coalesce(finished_at, started_at)) - epoch_ms(started_at) AS ms FROM scan_runs s LEFT JOIN c USING (run_id))
SELECT run_id, ms AS duration_ms, round(coalesce(done / nullif(ms / 1000.0::DOUBLE, 0), 0.0), 6) AS files_per_second, round(coalesce(100.0 * done / nullif(n, 0), 0.0), 6) AS progress, round(coalesce(100.0 * done / nullif(n, 0), 0.0), 6) AS hit_rate FROM r"""


def write_results(spark, sf_dir):
    """Totals of write results."""
    r = _calls(spark, sf_dir).select("success", (F.col("response_id") % 9).alias("units_written"))
    return A.write_stats(r)


WRITE_RESULTS = f"WITH {_CALLS} SELECT count(*) AS total, sum(success::BIGINT)::BIGINT AS successful, sum((NOT success)::BIGINT)::BIGINT AS failed, sum(CASE WHEN success THEN response_id % 9 ELSE 0 END)::BIGINT AS units_written, round(100.0 * sum(success::BIGINT) / count(*), 6) AS success_rate FROM c"


def batch_results(spark, sf_dir):
    """Fixed-size batches of each configuration's requests, joined with their results by key."""
    q = table(spark, sf_dir, "translate_requests").where("text IS NOT NULL").groupBy("config_hash", "request_id").agg(F.min("text").alias("text"))
    r = table(spark, sf_dir, "translate_responses").groupBy("request_id").agg(F.max("success").alias("success"))
    b = T.batches(q, ["request_id"], 50, ["config_hash"]).join(r, "request_id", "left")
    b = b.select("config_hash", "batch", F.length("text").alias("chars"), F.coalesce("success", F.lit(False)).alias("success")).withColumn("batch_id", F.concat_ws("-", "config_hash", "batch"))
    return A.batch_totals(b, "batch_id")


BATCH_RESULTS = """WITH q AS (SELECT config_hash, request_id, min(text) AS text FROM translate_requests WHERE text IS NOT NULL GROUP BY 1, 2), r AS (SELECT request_id, bool_or(success) AS success FROM translate_responses GROUP BY 1),
b AS (SELECT config_hash || '-' || ((row_number() OVER (PARTITION BY config_hash ORDER BY request_id) - 1) // 50) AS batch_id, length(text) AS chars, coalesce(success, false) AS success FROM q LEFT JOIN r USING (request_id))
SELECT batch_id, count(*) AS total_count, sum(chars)::BIGINT AS total_chars, sum(success::BIGINT)::BIGINT AS success_count, sum((NOT success)::BIGINT)::BIGINT AS failed_count FROM b GROUP BY 1"""


def region_merge(spark, sf_dir):
    """Touching intervals of each order merged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long").alias("a"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("string").alias("t"))
    return O.merge_intervals(li.select("l_orderkey", "a", (F.col("a") + F.col("q")).alias("b"), "t"), ["l_orderkey"], "a", "b", "t")


_IV = "iv AS (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS b, l_linenumber::VARCHAR AS t FROM lineitem)"
REGION_MERGE = f"""WITH {_IV}, m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS n, string_agg(t, '' ORDER BY a, b, t) AS t FROM g GROUP BY l_orderkey, k"""


def region_overlap(spark, sf_dir):
    """Intervals that begin before their predecessor ends."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long").alias("a"), F.col("l_quantity").cast("long").alias("q"))
    return O.overlaps(li.select("l_orderkey", "a", (F.col("a") + F.col("q")).alias("b")), ["l_orderkey"], "a", "b")


REGION_OVERLAP = f"WITH {_IV} SELECT * FROM (SELECT l_orderkey, a, b, lag(b) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS prev_end FROM iv) WHERE prev_end > a"


def offset_shift(spark, sf_dir):
    """Places after the changes before them."""
    m = table(spark, sf_dir, "verify_matches").select("path", "match_id", F.col("position.offset").cast("long").alias("pos"), O.length_change(F.col("extracted_text"), F.col("raw_match")).cast("long").alias("delta")).where("path IS NOT NULL AND delta IS NOT NULL").distinct()
    one = m.groupBy("path", "pos").agg(F.max("delta").alias("delta"))
    return O.shifted(one, ["path"], "pos", "delta")


OFFSET_SHIFT = """WITH m AS (SELECT path, pos, max(delta) AS delta FROM (SELECT DISTINCT path, match_id, position.offset::BIGINT AS pos, strlen(raw_match) - strlen(extracted_text) AS delta FROM verify_matches) WHERE path IS NOT NULL AND delta IS NOT NULL GROUP BY 1, 2)
SELECT *, pos + coalesce(sum(delta) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM m"""


def match_ordinals(spark, sf_dir):
    """Matches of each file in the order of their places."""
    m = table(spark, sf_dir, "verify_matches").where("path IS NOT NULL").select("path", "match_id", F.col("position.offset").alias("at")).distinct()
    return O.ordinals(m, ["path"], ["at", "match_id"]).select("path", "match_id", F.col("ordinal").cast("long").alias("ordinal"))


MATCH_ORDINALS = "SELECT path, match_id, row_number() OVER (PARTITION BY path ORDER BY position.offset, match_id) - 1 AS ordinal FROM (SELECT DISTINCT path, match_id, position FROM verify_matches WHERE path IS NOT NULL)"


def units_dedup(spark, sf_dir):
    """Units of three branches, the first of equal ones."""
    m = table(spark, sf_dir, "verify_matches").where("path IS NOT NULL AND extracted_text IS NOT NULL").select("path", F.col("match_id").alias("idx"), F.col("position.offset").alias("start_offset"), (F.col("position.offset") + F.octet_length("extracted_text")).alias("end_offset"), F.col("extracted_text").alias("content")).distinct()
    u = merged_units(m, m.where("idx % 2 = 0"), m.withColumn("content", F.upper("content")))
    return u.groupBy("branch").agg(F.count("*").alias("n"), F.sum("idx").alias("ids"))


UNITS_DEDUP = """WITH m AS (SELECT DISTINCT path, match_id AS idx, position.offset AS a, position.offset + strlen(extracted_text) AS b, extracted_text AS content FROM verify_matches WHERE path IS NOT NULL AND extracted_text IS NOT NULL),
u AS (SELECT *, 0 AS branch FROM m UNION ALL SELECT *, 1 FROM m WHERE idx % 2 = 0 UNION ALL SELECT path, idx, a, b, upper(content), 2 FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY path, a, b, content ORDER BY branch, idx) AS n FROM u) SELECT branch, count(*) AS n, sum(idx)::BIGINT AS ids FROM k WHERE branch = 0 OR n = 1 GROUP BY 1"""

_PROVIDERS = [("small", 200), ("medium", 1000), ("large", 5000), ("any", 0)]
_WEIGHTS = {"a": 5, "b": 1, "c": 2, "off": 0}


def capable_providers(spark, sf_dir):
    """Providers by capacity, turns and weights."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = T.capable(d, _PROVIDERS)
    return t.select("doc_id", F.array_join("capable", ",").alias("capable"), T.round_robin(F.col("doc_id"), ["x", "y", "z"]).alias("turn"), T.weighted(F.col("doc_id"), _WEIGHTS).alias("weighted"))


CAPABLE = "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} = 0 OR strlen(text) <= {c} THEN '{i}' END" for i, c in _PROVIDERS) + "], lambda x: x IS NOT NULL), ',') END AS capable, ['x', 'y', 'z'][doc_id % 3 + 1] AS turn, " + f"{T.schedule(_WEIGHTS)!r}[doc_id % {len(T.schedule(_WEIGHTS))} + 1] AS weighted FROM documents"

_ROWS = [("p1", ["m1", "m2"], 5, 4000, "real-1", True), ("p2", ["m3"], 2, 0, "your-api-key", True), ("p3", ["m4"], 9, 900, "real-3", False), ("p4", ["m5"], 1, 700, "k-4", True), ("p4", ["m6"], 1, 700, "k-5", True)]


def provider_table(spark, sf_dir):
    """Usable providers, one row per model, with repeats counted."""
    raw = spark.createDataFrame(_ROWS, "id string, models array<string>, rate int, max_input_chars int, api_key string, enabled boolean")
    p = T.usable(T.expand_models(raw))
    dup = T.duplicate_ids(p).withColumnRenamed("n", "repeats")
    return p.join(dup, "id", "left").select("id", "model", "rate", "max_input_chars", F.coalesce("repeats", F.lit(1)).alias("repeats"))


PROVIDER_TABLE = "SELECT id, model, rate, max_input_chars, repeats::BIGINT AS repeats FROM (VALUES ('p1/m1', 'm1', 5, 4000, 1), ('p1/m2', 'm2', 5, 4000, 1), ('p4', 'm5', 1, 700, 2), ('p4', 'm6', 1, 700, 2)) v(id, model, rate, max_input_chars, repeats)"


def provider_capacity(spark, sf_dir):
    """Least and greatest capacity, and a JSON summary."""
    raw = spark.createDataFrame(_ROWS, "id string, models array<string>, rate int, max_input_chars int, api_key string, enabled boolean")
    p = T.expand_models(raw)
    return T.capacity(p)


PROVIDER_CAPACITY = "SELECT 700 AS threshold, 4000 AS max_capacity"


def provider_health(spark, sf_dir):
    """State of the providers after all their calls."""
    return T.health(_calls(spark, sf_dir), ["provider"], ["ts", "response_id"])


def _current(spark, sf_dir):
    """(path, content): the current content of every file."""
    return table(spark, sf_dir, "source_files").groupBy("path").agg(F.max_by("content", "scanned_at").alias("content"))


def located(spark, sf_dir):
    """Matches located in their files: at their place, else at the first occurrence;
    in contents that its SQL can decode."""
    from loomtext.functions import encoding as E

    f = _current(spark, sf_dir).where(E.is_utf8(F.col("content")))
    return _located(spark, sf_dir, f.select("path", E.to_text(F.col("content"), F.lit("UTF-8")).alias("text")))


def located_all(spark, sf_dir):
    """Matches located in all files of any encoding."""
    from loomtext.functions import encoding as E

    return _located(spark, sf_dir, _current(spark, sf_dir).select("path", E.any_text(F.col("content")).alias("text")))


def _located(spark, sf_dir, f):
    """A file's matches are located in one pass over its text, which isn't copied to each of them."""
    f = f.select("path", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))
    m = table(spark, sf_dir, "verify_matches").where("raw_match IS NOT NULL").select("match_id", "path", "raw_match", F.col("position.offset").alias("at")).distinct()
    own = m.groupBy("path").agg(F.collect_list(F.struct("match_id", "raw_match", "at")).alias("own"))
    text = F.col("text")

    def place(x):
        exact = C.byte_slice(text, x["at"], x["at"] + F.octet_length(x["raw_match"])) == x["raw_match"]
        return F.struct(x["match_id"].alias("match_id"), F.coalesce(exact, F.lit(False)).alias("exact"), F.nullif(F.instr(text, x["raw_match"]), F.lit(0)).cast("long").alias("first"))

    return own.join(f, "path").select(F.explode(F.transform("own", place)).alias("r")).select("r.*")


LOCATED = """WITH f AS (SELECT path, arg_max(content, scanned_at) AS content FROM source_files GROUP BY path), t AS (SELECT path, replace(regexp_replace(try(decode(content)), '\\A\\x{FEFF}', ''), chr(13) || chr(10), chr(10)) AS text FROM f WHERE try(decode(content)) IS NOT NULL),
m AS (SELECT DISTINCT match_id, path, raw_match, position.offset AS pos FROM verify_matches WHERE raw_match IS NOT NULL)
SELECT match_id, coalesce(try(decode(encode(text)[pos + 1:pos + strlen(raw_match)])) = raw_match, false) AS exact, nullif(instr(text, raw_match), 0)::BIGINT AS "first" FROM m JOIN t USING (path)"""

def applied_units(spark, sf_dir):
    """Upper-cased texts put in the place of the matches of each file."""
    from loomtext.functions import encoding as E
    from loomtext.operators import writer as W

    f = _current(spark, sf_dir).select("path", E.any_text(F.col("content")).alias("text"))
    m = table(spark, sf_dir, "verify_matches").where("raw_match IS NOT NULL AND lower(category) <> 'code'").select("path", "match_id", "extracted_text", "raw_match", "position").distinct()
    u = m.select("path", F.col("extracted_text").alias("content"), F.upper("extracted_text").alias("translated"), "raw_match", F.col("position.line").alias("line"), F.col("position.column").alias("column"))
    a = W.apply_units(spread(f), u)
    return a.groupBy("changed", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.sum((F.upper("before") == F.upper("after")).cast("long")).alias("same_letters"))


def translated_units(spark, sf_dir):
    """Requests through the offline providers, in weighted turns."""
    from loomtext.operators import translate as X

    q = table(spark, sf_dir, "translate_requests").where("text IS NOT NULL").select("request_id", F.col("text").alias("content"), "source_lang", "target_lang").dropDuplicates(["request_id"])

    def make():
        return X.Service([X.EchoProvider("big"), X.EchoProvider("small", 300)], {"big": 1, "small": 2})

    return X.totals(X.translate(spread(q), make))


TRANSLATED_UNITS = "SELECT count(*) AS total, count(*) AS success_count, 0::BIGINT AS failed_count, sum(length(text))::BIGINT AS total_chars FROM (SELECT request_id, any_value(text) AS text FROM translate_requests WHERE text IS NOT NULL GROUP BY 1)"

QUERIES = {
    "applied_units": (applied_units, None), "translated_units": (translated_units, TRANSLATED_UNITS), "hourly_events": (M.hourly_events, M.HOURLY_EVENTS),
    "cache_hits": (cache_hits, CACHE_HITS), "pending_files": (pending_files, PENDING_FILES), "orphan_entries": (orphan_entries, ORPHANS), "cache_latest": (cache_latest, CACHE_LATEST),
    "cache_stats": (cache_stats, CACHE_STATS), "backups": (backups, BACKUPS), "provider_stats": (provider_stats, PROVIDER_STATS), "merged_stats": (merged_stats, MERGED_STATS),
    "run_counters": (run_counters, RUN_COUNTERS), "run_reports": (run_reports, RUN_REPORTS), "write_results": (write_results, WRITE_RESULTS), "batch_results": (batch_results, BATCH_RESULTS),
    "region_merge": (region_merge, REGION_MERGE), "region_overlap": (region_overlap, REGION_OVERLAP), "offset_shift": (offset_shift, OFFSET_SHIFT), "match_ordinals": (match_ordinals, MATCH_ORDINALS),
    "units_dedup": (units_dedup, UNITS_DEDUP), "capable_providers": (capable_providers, CAPABLE), "provider_table": (provider_table, PROVIDER_TABLE), "provider_capacity": (provider_capacity, PROVIDER_CAPACITY),
    "provider_health": (provider_health, None), "located": (located, LOCATED), "located_all": (located_all, None),
}
