"""p1: splitting oversized texts by content-defined chunking.

A rolling hash over the last 32 characters marks landmarks that depend on the content only.
Within the least and the greatest size of a piece the first landmark is taken and the cut
snaps to the nearest natural boundary around it: an end of a sentence or line if there is
one in reach, else white space. Only where the reach holds no boundary at all is the piece cut at
the limit. As landmarks don't move with their distance from the start, an edit alters the
pieces around it and the later cuts fall where they fell.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.session import batch_rows, table

#: The characters that end an unbroken run (p1's definition).
BREAKS = " \t\r\n　.!?;。！？；"
_STOPS = np.array([ord(c) for c in ".!?;。！？；"], dtype=np.uint32)
_BLANKS = np.array([ord(c) for c in " \t\r\n　"], dtype=np.uint32)
_BLANK_SET = frozenset(_BLANKS.tolist())
_LINES = np.array([ord(c) for c in "\r\n"], dtype=np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？；"], dtype=np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(cp: np.ndarray) -> np.ndarray:
    """At each place a hash of the 32 characters up to it: sum of g(c) << age, mod 2**32."""
    h = (cp * np.uint32(2654435761)) ^ (cp >> np.uint32(3)) * np.uint32(40503)
    for k in range(5):
        step = 1 << k
        if len(h) <= step:
            break
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
    return h


def longest_run(cp: np.ndarray) -> int:
    """Length of the longest run without any of BREAKS."""
    at = np.flatnonzero(np.isin(cp, _STOPS) | np.isin(cp, _BLANKS))
    return int(np.diff(np.concatenate(([-1], at, [len(cp)]))).max() - 1) if len(cp) else 0


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a cut before the character of that index) after a sentence or line, and after
    a blank or stop of any kind."""
    blank, stop = np.isin(cp, _BLANKS), np.isin(cp, _STOPS)
    line = np.isin(cp, _LINES)
    nxt = np.zeros(len(cp), dtype=bool)
    nxt[:-1] = blank[1:]
    crlf = np.zeros(len(cp), dtype=bool)
    crlf[:-1] = (cp[:-1] == 13) & (cp[1:] == 10)
    prev_stop = np.zeros(len(cp), dtype=bool)
    prev_stop[1:] = stop[:-1]
    strong = (line & ~crlf) | (blank & prev_stop) | np.isin(cp, _WIDE_STOPS)
    return np.flatnonzero(strong & ~crlf) + 1, np.flatnonzero((blank | stop) & ~crlf) + 1


def _nearest(places: np.ndarray, low: int, high: int, goal: int) -> int:
    """The place in [low, high] nearest to the goal (the earlier of two), or -1."""
    i, j = np.searchsorted(places, [low, high + 1])
    if i == j:
        return -1
    p = places[i:j]
    k = int(np.searchsorted(p, goal))
    near = [int(p[x]) for x in (k - 1, k) if 0 <= x < len(p)]
    return min(near, key=lambda x: (abs(x - goal), x))


def _whole_sign(text: str, at: int, low: int) -> int:
    """Move a forced cut back so that it parts neither CR LF nor a sign from its marks."""
    x = at
    while x > low and x < len(text) and (unicodedata.combining(text[x]) or text[x] in "‍️" or text[x - 1] == "‍" or text[x - 1 : x + 1] == "\r\n"):
        x -= 1
    return x if x > low else at


def split(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """[(start, end, cut)] in characters; cut tells how the piece ends: sentence, blank,
    forced or end. Every piece has at most limit characters and starts exactly
    min(overlap, limit - 1) characters before the end of the piece before it.
    A limit below 1 counts as 1, a negative overlap as 0.
    """
    n = len(text)
    limit = max(1, int(limit))
    overlap = max(0, min(int(overlap), limit - 1))
    if n <= limit:
        return [(0, n, "end")]
    cp = points(text)
    h = rolling(cp)
    bits = max(1, (max(4, limit // 8)).bit_length() - 1)
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    strong, weak = boundaries(cp)
    least = max(overlap + 1, limit // 2)
    out, start = [], 0
    while n - start > limit:
        low, high = start + least, start + limit
        i = int(np.searchsorted(marks, low))
        goal = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        end, how = _nearest(strong, low, high, goal), "sentence"
        if end < 0:
            end, how = _nearest(weak, low, high, goal), "blank"
        if end < 0 and cp[high] in _BLANK_SET:  # a whole piece that a blank follows
            end, how = high, "blank"
        if end < 0:  # nothing in reach: the last boundary before it that still makes progress
            end, how = _nearest(weak, start + overlap + 1, low, low), "blank"
        if end < 0:
            end, how = _whole_sign(text, high, start + overlap + 1), "forced"
        out.append((start, end, how))
        start = end - overlap
    out.append((start, n, "end"))
    return out


PIECES = "piece_no int, start int, end int, cut string, piece string"


def pieces(df: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """(key, piece_no, start, end, cut, piece) of every row.

    limit and overlap are columns. A null text gives no piece, an empty text one empty piece;
    a null limit leaves the text whole.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(limit).cast("long").alias("__l"), F.coalesce(F.col(overlap), F.lit(0)).cast("long").alias("__o"))
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, t, lim, over in zip(*(b.column(i).to_pylist() for i in range(4))):
                if lim is None:
                    rows.append((k, 0, 0, len(t), "end", t))
                    continue
                rows += [(k, i, s, e, how, t[s:e]) for i, (s, e, how) in enumerate(split(t, lim, over))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()])],
                names=[key, "piece_no", "start", "end", "cut", "piece"],
            )

    return src.mapInArrow(run, f"`{key}` {kind}, {PIECES}")


def kind_of_cut(text: str, limit: int, overlap: int) -> str:
    """forced or natural, from the pieces of a text: a run of more than limit characters without a break
    always makes a forced cut, so a text without one is natural. As the overlap takes room from a piece,
    shorter runs may be cut, too; so forced cuts are checked against the longest run."""
    forced = any(how == "forced" for *_, how in split(text, limit, overlap))
    return "forced" if forced and longest_run(points(text)) > limit else "natural"


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request whose text is longer than its policy allows. Rows delivered twice
    are reduced after the filter, so only long texts are shuffled; of several texts under one
    request_id the one ingested first counts (ties: the smaller text)."""
    req = table(spark, sf_dir, "translate_requests").select("request_id", "config_hash", "text", "ingested_at").where(F.col("request_id").isNotNull())
    conf = table(spark, sf_dir, "translate_configs").select("config_hash", "policy_id").dropDuplicates(["config_hash"])
    pol = table(spark, sf_dir, "limit_policies").select("policy_id", "max_char_count", "split_max_chars", "overlap_chars").dropDuplicates(["policy_id"])
    rules = conf.join(pol, "policy_id").drop("policy_id")
    long = req.join(rules, "config_hash").where(F.length("text") > F.col("max_char_count"))
    row = F.struct("text", "split_max_chars", "overlap_chars")
    return long.groupBy("request_id").agg(F.min_by(row, F.struct("ingested_at", "text")).alias("r")).select("request_id", "r.*")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized requests."""
    batch_rows(spark, 2000)
    return pieces(oversized(spark, sf_dir), "request_id", "text", "split_max_chars", "overlap_chars")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, cut): the oversized requests, cut as their pieces tell. A null limit or overlap counts as in pieces()."""
    batch_rows(spark, 2000)

    @F.pandas_udf(StringType())
    def label(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series(["natural" if pd.isna(m) else kind_of_cut(t, int(m), int(o)) for t, m, o in zip(text, limit, overlap)], dtype=object)

    return oversized(spark, sf_dir).select("request_id", label("text", "split_max_chars", F.coalesce("overlap_chars", F.lit(0))).alias("cut"))


P1_SQL = r"""
WITH r AS (
  SELECT r.request_id, arg_min(r.text, r.ingested_at) AS text, any_value(p.split_max_chars) AS m
  FROM translate_requests r JOIN translate_configs c USING (config_hash) JOIN limit_policies p USING (policy_id)
  WHERE length(r.text) > p.max_char_count GROUP BY 1)
SELECT request_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n\x{3000}.!?;。！？；]'), lambda x: length(x))) > m
       THEN 'forced' ELSE 'natural' END AS "cut" FROM r
"""
