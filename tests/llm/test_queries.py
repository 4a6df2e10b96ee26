"""The p queries over small tables: doubled rows, extra columns, nulls, empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from loomtext.llm import mixing, mojibake, packing, queries, tokens

DATA = "/root/testdata/sf0.001"
FOUND = ["p1_found", "p2_found", "p3_found", "p4_found", "p7_found", "p8_ids", "p10_found"]
NAMES = [f[:-8] for f in os.listdir(DATA)]
EXTRA = {"idx": 1, "h": 2, "r": 3, "k": 4, "f0": "x", "ids": 5, "piece": "x", "container": "x", "lang_": 6, "start": 7, "bucket": 8, "score": 9.0, "defect": "x", "issue": "x", "cut": "y"}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    from tests.conftest import _SPARK as spark

    d, e = str(tmp_path_factory.mktemp("doubled")), str(tmp_path_factory.mktemp("empty"))
    for n in NAMES:
        t = spark.read.parquet(f"{DATA}/{n}.parquet")
        t.limit(0).write.parquet(f"{e}/{n}.parquet")
        x = t if n in ("documents", "mix_targets", "lang_samples", "review_labels") else t.union(t)
        for c, v in EXTRA.items():
            if c not in x.columns:
                x = x.withColumn(c, F.lit(v))
        nulls = spark.createDataFrame([], x.schema)
        if n in ("translate_requests", "translate_responses", "verify_matches"):
            nulls = x.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema])
        x.union(nulls).coalesce(2).write.parquet(f"{d}/{n}.parquet")
    return d, e


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", FOUND)
def test_repeated_rows_nulls_and_extra_columns_change_nothing(spark, folders, name):
    q = queries.queries()[name]
    want = q(spark, DATA)
    got = q(spark, folders[0])
    assert got.columns == want.columns and rows(got) == rows(want)
    assert got.count() == got.distinct().count() > 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folders, name):
    assert queries.queries()[name](spark, folders[1]).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(FOUND)))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_mix_meets_budgets(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 1 + i % 7) for i in range(600)] + [(900, None, 5), (901, "z", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.0, 1), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")
    m, plan = mixing.mix(docs, targets)
    r = mixing.report(m, plan)
    got = {x["source"]: x for x in r.collect()}
    assert got["gone"]["tokens"] == got["c"]["tokens"] == 0
    for s in "ab":
        assert 0 <= got[s]["budget"] - got[s]["tokens"] <= 7
        assert got[s]["budget"] <= got[s]["max_repeats"] * got[s]["available"]
    assert abs(got["a"]["share"] / got["b"]["share"] - 5 / 3) < 0.05
    assert m.agg(F.max("copies")).first()[0] <= 2 and m.count() == m.dropDuplicates(["doc_id"]).count()
    got = {x["source"]: x for x in mixing.report(*mixing.mix(docs, targets, total_tokens=5000)).collect()}
    assert got["a"]["tokens"] == 2 * got["a"]["available"] and got["b"]["tokens"] == got["b"]["available"]
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_mix_leaves_no_gap_that_a_document_fits(spark):
    """However many passes it takes: sizes fall so that each pass leaves a gap."""
    sizes = [97, 61, 43, 29, 17, 11, 7, 5, 3, 2, 1] * 9
    docs = spark.createDataFrame([(i, "a", n) for i, n in enumerate(sizes)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    for total in (50, 333, 1000):
        m, plan = mixing.mix(docs, targets, total_tokens=total)
        r = mixing.report(m, plan).first()
        left = [x["n_tokens"] for x in docs.join(m, "doc_id", "left_anti").collect()]
        assert r["tokens"] <= total and all(n > total - r["tokens"] for n in left)


def test_examples_keep_three_limits(spark):
    items = packing.example_items(spark, DATA)
    p = packing.p6_examples(spark, DATA).join(items.drop("target_lang"), "response_id")
    use = p.groupBy("example").agg(F.sum("n_tokens").alias("t"), F.sum("segments").alias("s"), F.sum("loss_tokens").alias("l"))
    over = (F.col("t") > packing.MAX_TOKENS) | (F.col("s") > packing.MAX_SEGMENTS) | (F.col("l") > packing.MAX_LOSS)
    assert p.count() == items.count() > 50 and use.where(over & (F.col("s") > 1)).count() == 0
    full = use.agg(*[F.max(c) for c in "tsl"], F.sum((F.col("l") > 0.95 * packing.MAX_LOSS).cast("int"))).first()
    assert full[3] > 0  # the limit of the loss binds


def test_packing_of_a_hot_group(spark):
    items = spark.createDataFrame([("g" if i % 3 else None, str(i), 1, 1 + i % 9, 4, 20) for i in range(900)], "g string, item string, n int, c int, most int, room int")
    p = packing.pack_groups(items, "g", "item", ["n", "c"], ["most", "room"], shard=100).join(items.drop("g"), "item")
    use = p.groupBy("container").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.countDistinct("g").alias("gs"))
    assert p.count() == 900 and use.where("n > 4 OR c > 20 OR gs > 1").count() == 0
    assert use.count() <= 1.25 * (items.agg(F.sum("c")).first()[0] / 20)


def test_ids_round_trip(spark):
    d = spark.createDataFrame([(1, "Hello 世界 \r\n"), (2, None), (3, ""), (4, "x" * 70_000 + " y" * 100)], "doc_id long, text string")
    ids = tokens.with_ids(d, "text", ["doc_id"])
    back = {r["doc_id"]: bytes(r["content"]) for r in tokens.decoded(ids, ["doc_id"]).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").encode() for r in d.collect()}


def test_core_runs_without(tmp_path):
    """A copy without the subpackage and its tests still imports and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[2]
    shutil.copytree(here / "loomtext", tmp_path / "loomtext", ignore=lambda d, names: [n for n in names if n == "llm" or n == "__pycache__"])
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout
    assert "lex_tokens" in out and "p5_found" in out and "p1_found" not in out and out.strip().endswith("True")
    for f in (here / "loomtext").rglob("*.py"):
        assert "llm" in f.relative_to(here).parts or "loomtext.llm" not in f.read_text(), f


def test_shares_are_of_the_whole_file(spark, tmp_path):
    """A language's letters are divided by all letters of its file, matches without language included."""
    from loomtext.llm import codetext

    for n in NAMES:
        if n != "verify_matches":
            os.symlink(f"{DATA}/{n}.parquet", tmp_path / f"{n}.parquet")
    comment, code = "The parser is created once and shared by all workers.", "abcde = fghij(klmno, pqrst)\n"
    t = spark.read.parquet(f"{DATA}/verify_matches.parquet")
    rows = [(-1, "a.py", f"# {comment}\n{code}"), (-2, "a.py", code * 3), (-3, "b.py", code)]
    rest = t.where("lower(trim(category)) = 'code'").select("match_id", F.concat(F.lit("z/"), "path").alias("path"), "extracted_text").where("extracted_text IS NOT NULL")
    spark.createDataFrame(rows, "match_id long, path string, extracted_text string").union(rest).withColumn("category", F.lit("code")).coalesce(1).write.parquet(str(tmp_path / "verify_matches.parquet"))
    got = codetext.p7_shares(spark, str(tmp_path)).collect()
    n, size = codetext.letters(comment), codetext.letters(comment) + 4 * codetext.letters(code)
    assert [(r["path"], r["lang"], r["letters"], r["share"]) for r in got if r["path"] in ("a.py", "b.py")] == [("a.py", "en", n, round(n / size, 6))]
    assert all(0 < r["share"] < 1 for r in got) and len(got) > 1


def test_whole_counts_escapes_as_letters():
    from loomtext.llm import codetext

    assert codetext.whole(r"x = '\u4f60\u597d'", "py") == 3 and codetext.whole("<a b='&#20013;'>", "html") == 3 and codetext.whole(None, "py") == 0


def test_labelled_text_is_counted_whole(spark, tmp_path):
    """Characters that stand only in few of many rows, or only in long texts, are known like all others."""
    real = "找不到文件，因此会新建一个。"
    ids = [r["id"] for r in spark.range(13_000).orderBy(F.xxhash64("id")).collect()]
    texts = {i: (f"Press key number {i} to go on.", "en") for i in ids}
    texts[ids[-1]] = (real[:7] + "，", "zh")  # the last ones in the order of the hash
    texts[ids[-2]] = (real[:7] + "！", "Chinese")
    texts[ids[0]] = ((real[7:] + "\n") * 300, "zh_CN")
    texts[ids[1]] = ("Ã¤ Ã¤ as garbled text is labelled", "xx")
    texts[ids[2]] = ("Ã¤ Ã¤ �", "de")
    spark.createDataFrame([(i, *v) for i, v in texts.items()], "response_id long, original_text string, source_lang string").write.parquet(f"{tmp_path}/translate_responses.parquet")
    spark.createDataFrame([("The file is here.", "en")], "text string, lang string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    bad = real.encode("gbk").decode("latin-1")
    spark.createDataFrame([(1, bad, "// " + bad), (2, real, real), (3, "plain", None)], "match_id long, extracted_text string, raw_match string").write.parquet(f"{tmp_path}/verify_matches.parquet")
    got = {(r["match_id"], r["field"]): r["restored"] for r in queries.queries()["p3_restored"](spark, str(tmp_path)).collect()}
    assert got == {(1, "extracted_text"): real, (1, "raw_match"): "// " + real}
    assert queries.queries()["p3_found"](spark, str(tmp_path)).count() == 2
    n = mojibake.plain_characters(spark, str(tmp_path))
    assert n["个"] == 300 and n["找"] == 2 and "Ã" not in n
