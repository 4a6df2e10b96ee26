import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.incremental import merkle as M
from loomtext.operators import windows as O
from loomtext.streaming import streams as R


def state(spark, d):
    return spark.createDataFrame(sorted(d.items()), "key string, digest string")


def changes(spark, a, b, levels=2):
    c = M.changes(M.leaves(state(spark, a), "key", "digest", levels), M.leaves(state(spark, b), "key", "digest", levels), levels)
    return {(r["key"], r["change"]) for r in c.collect()}


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    a = {f"k{i}": str(rng.random()) for i in range(300)}
    b = {k: v for k, v in a.items() if rng.random() > 0.05} | {f"n{i}": "x" for i in range(7)}
    for k in rng.sample(sorted(set(a) & set(b)), 9):
        b[k] = "changed"
    want = {(k, "removed") for k in a.keys() - b.keys()} | {(k, "added") for k in b.keys() - a.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert changes(spark, a, b) == want
    assert changes(spark, a, a) == set() and changes(spark, {}, {}) == set()
    assert changes(spark, {}, {"x": "1"}) == {("x", "added")}


def test_only_differing_ranges_are_opened(spark):
    a = {f"k{i}": "1" for i in range(2000)}
    b = a | {"k7": "2"}
    t = [M.tree(M.bottom(M.leaves(state(spark, x), "key", "digest", 2)), 2) for x in (a, b)]
    assert M.differing(*t, 2).count() == 1 and M.differing(t[0], t[0], 2).count() == 0


def test_depth_follows_the_number_of_leaves():
    assert [M.levels_for(n) for n in (0, 1, 5_000, 100_000, 10**7, 10**9, 10**15)] == [1, 1, 2, 3, 4, 6, 7]
    assert all(10**k / 16 ** M.levels_for(10**k) < 16 * M.LEAVES_PER_NODE for k in range(10))


def test_paths_and_hashes(spark):
    df = spark.createDataFrame([("./a//b",), ("a\\b",), (" a/./b/",), ("a/x/../b",), ("a.b/c",), ("../a",), ("a/b/c/d/../../../../e",), ("/../x/./../y/",), ("../../a/..",), ("/",), (None,)], "p string")
    assert [r[0] for r in df.select(M.clean_path(F.col("p"))).collect()] == ["a/b", "a/b", "a/b", "a/b", "a.b/c", "../a", "e", "/y", "../..", "/", None]
    df = spark.createDataFrame([("SHA256:AB",), (" 0xab ",), ("a-b",), (None,)], "h string")
    assert [r[0] for r in df.select(M.clean_hash(F.col("h"))).collect()] == ["ab", "ab", "ab", None]


def test_pending(spark):
    files = spark.createDataFrame([("a", b"1", 1), ("a", b"2", 2), ("b", b"1", 1), ("c", None, None), (None, b"x", 1)], "path string, content binary, at int")
    files = files.select("path", "content", F.make_timestamp(F.lit(2026), F.lit(1), F.coalesce("at", F.lit(None)), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz").alias("scanned_at"), F.lit(1).alias("run_id"))
    sha = lambda x: __import__("hashlib").sha256(x).hexdigest()
    cache = spark.createDataFrame(
        [("./a", sha(b"2").upper(), True, 1, 5), ("a", sha(b"9"), True, 2, 9), ("b", "sha256:" + sha(b"1"), True, 1, 5), ("b", sha(b"0"), False, 1, 6), ("c", sha(b""), True, None, 5), (None, "x", True, 1, 1)],
        "path string, file_hash string, is_translated boolean, run_id long, created_at long")
    runs = spark.createDataFrame([(1, "success"), (2, "failed"), (3, None)], "run_id long, status string")
    assert [r["path"] for r in M.pending(files, cache, runs).collect()] == ["c"]
    empty = cache.limit(0)
    assert sorted(r["path"] for r in M.pending(files, empty, runs).collect()) == ["a", "b", "c"]
    assert M.pending(files.limit(0), cache, runs).collect() == []


def test_ledger_survives_failures(spark, tmp_path):
    book = M.Ledger(spark, str(tmp_path / "ledger"))
    work = lambda keys: keys.select("key", F.lit(1).alias("done"))
    one, two = {"a": "1", "b": "1"}, {"a": "1", "b": "2", "c": "1"}
    assert book.output() is None
    v1 = book.run(state(spark, one), work)
    with pytest.raises(RuntimeError):
        book.run(state(spark, two), work, fail_before_publish=True)
    assert book.current() == v1 and book.output().count() == 2
    book.run(state(spark, two), work)
    assert sorted(r["key"] for r in book.output().collect()) == ["a", "b", "b", "c"]
    assert book.run(state(spark, two), work) is None  # nothing is repeated


def test_ledger_takes_the_state_once(spark, tmp_path):
    """The source changes while a run works: what the run didn't see is done by the next one, nothing twice."""
    src = str(tmp_path / "src")
    state(spark, {"a": "1", "b": "1"}).write.parquet(src)
    book = M.Ledger(spark, str(tmp_path / "ledger"))

    def work(keys):
        if not (tmp_path / "src2").exists():
            state(spark, {"c": "1"}).write.parquet(str(tmp_path / "src2"))
            state(spark, {"c": "1"}).write.mode("append").parquet(src)
        return keys.select("key")

    book.run(spark.read.parquet(src), work)
    assert sorted(r["key"] for r in book.output().collect()) == ["a", "b"]
    book.run(spark.read.schema("key string, digest string").parquet(src), work)
    assert sorted(r["key"] for r in book.output().collect()) == ["a", "b", "c"]


def test_two_runs_at_once(spark, tmp_path):
    """Both start from one parent: the first publishes, the other is refused and finds nothing left to do."""
    one, two = (M.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    s = {"a": "1"}

    def slow(keys):
        two.run(state(spark, s), lambda k: k.select("key"))
        return keys.select("key")

    with pytest.raises(M.Conflict):
        one.run(state(spark, s), slow)
    assert [r["key"] for r in one.output().collect()] == ["a"] and one.run(state(spark, s), slow) is None


def test_ledger_reads_only_differing_parts_and_grows(spark, tmp_path):
    book = M.Ledger(spark, str(tmp_path / "ledger"))
    work = lambda keys: keys.select("key")
    a = {f"k{i}": "1" for i in range(6000)}
    book.run(state(spark, a), work)
    book.run(state(spark, a | {"k5": "2"} | {"new": "1"}), work)
    assert book.output().count() == 6002 and book.head()["levels"] == 2
    b = {f"k{i}": "1" for i in range(6000, 6010)} | {"k5": "2"}
    book.run(state(spark, b), work)  # far fewer keys: all others are removed, ten are added
    assert book.output().count() == 6012 and book.leaves().count() == 11


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), max_size=15))
def test_intervals(rows):
    from tests.conftest import _SPARK as spark

    df = spark.createDataFrame([(k, a, a + n, str(i)) for i, (k, a, n) in enumerate(rows)], "k int, a int, b int, t string")
    got = sorted((r["k"], r["a"], r["b"], r["n"]) for r in O.merge_intervals(df, ["k"], "a", "b", "t").collect())
    want = []
    for k in range(3):
        for a, b in sorted((a, a + n) for x, a, n in rows if x == k):
            if want and want[-1][0] == k and a <= want[-1][2]:
                want[-1][2:] = [max(want[-1][2], b), want[-1][3] + 1]
            else:
                want.append([k, a, b, 1])
    assert got == [tuple(w) for w in want]


def test_islands(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 2, "b"), ("p", 5, "c"), ("q", 3, "d"), ("q", None, "x")], "p string, n int, t string")
    got = sorted((r["p"], r["start_line"], r["end_line"], r["texts"]) for r in O.islands(df, ["p"], "n", "t").collect())
    assert got == [("p", 1, 2, ["a", "b"]), ("p", 5, 5, ["c"]), ("q", 3, 3, ["d"])]
    assert O.islands(df.limit(0), ["p"], "n").collect() == []


def test_numbering_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(500)], "k string, o int")
    got = O.numbered(df, ["k"], ["o"], partitions=7).collect()
    want = {}
    for r in sorted(got, key=lambda r: r["o"]):
        assert r["number"] == want.setdefault(r["k"], 0)
        want[r["k"]] += 1
    assert len(got) == 500 and O.numbered(df.limit(0), ["k"], ["o"]).collect() == []


def test_stream_is_exactly_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).write.parquet(src)
    run = lambda: R.run_available(R.files_stream(spark, src, "id long", 1), lambda df: df.selectExpr("id", "id * 2 AS twice"), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    run()
    run()
    spark.range(10, 13).write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(13))


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp '2026-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp '2026-01-01 00:50:00', 'a' UNION ALL SELECT timestamp '2026-01-01 05:00:00', 'b'").coalesce(1).write.parquet(src)
    s = R.windowed_counts(R.files_stream(spark, src, "ts timestamp, k string"), "ts", "k")
    q = s.writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["k"], r["n"]) for r in spark.sql("SELECT k, n FROM win").collect()] == [("a", 2)]
