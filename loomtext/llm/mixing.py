"""p9: mixing sources to target weights.

Each document gets a hash-random key. Within a source the documents are put in the order
of the keys; a distributed prefix sum gives every document its place on the source's token
axis, and the source is cut at its exact budget, after whole epochs if the budget is larger
than the source.

Prefix sums without a single task per source: the key space is cut into ranges; the
tokens of every (source, range) are summed first, then the ranges' sums are prefix-summed, and only
within the ranges before the cut are rows sorted. The number of ranges follows from the number of rows. A source that holds a
third of all rows is spread over all its ranges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.tokens import with_counts
from loomtext.session import batch_rows, cut, spread, table

#: Rows of a range, about, and the least number of ranges.
RANGE_ROWS, RANGES = 20_000, 64
#: Rows of the ranges' sums up to which they are broadcast.
FEW = 100_000
SEED = 20


def budgets(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget) of every target.

    totals: (source, available tokens). Without total_tokens the total is the largest one at
    which every source with documents and a share meets it within its repeats: the shares
    are then as near to the targets as they can be. With total_tokens a source gets at
    most max_repeats * available. A source without documents, or with a share that is 0,
    null or negative, gets 0; null max_repeats counts as 1; repeated targets: the largest share.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.max_by("max_repeats", "target_share"), F.lit(1)).cast("long").alias("max_repeats"),
    )
    b = t.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("max_repeats") * F.col("available")
    live = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(F.lit(0.0))
    b = b.withColumn("live", live)
    # one row of numbers: shares of the live sources are scaled to sum 1; the scarcest of them bounds the total
    one = b.agg(F.min(F.when(F.col("live") > 0, most / F.col("live"))).alias("scarcest"), F.sum("live").alias("live")).first()
    if total_tokens is None:
        total = one["scarcest"]
    else:
        total = total_tokens / one["live"] if one["live"] else None
    return b.select(
        "source", "target_share", "max_repeats", "available",
        F.least(F.coalesce(F.floor(F.lit(total).cast("double") * F.col("live") + F.lit(0.5)), F.lit(0)), most).cast("long").alias("budget"),
    )


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(members, report). docs: doc_id, source, n_tokens.

    members: (doc_id, source, n_tokens, copies), copies >= 1 how often the document is in the
    mix. Of the last epoch the documents up to the cut are in; the document across the cut
    is left out and the gap is filled by documents behind the cut, until none that is left fits into its source's
    gap, so the tokens never exceed the budget. Ties of the key are ordered by
    doc_id; repeated doc_ids of a source add up their copies. report: (source, target_share, max_repeats,
    available, budget, tokens, share, epochs).
    """
    names = targets.where(F.col("source").isNotNull()).select("source").distinct()
    n_names = names.limit(FEW + 1).count()
    small = _broadcast_if(n_names <= FEW)  # one row per target
    named = docs.join(small(names), "source", "left_semi")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = cut(named.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), key.alias("key")))
    ranges = 1 << max(RANGES, keyed.count() // RANGE_ROWS).bit_length() - 1
    keyed = keyed.withColumn("range", F.shiftrightunsigned("key", 64 - (ranges.bit_length() - 1)).cast("long"))
    sums = _broadcast_if(n_names * ranges <= FEW)  # one row per target and range
    available = keyed.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = cut(budgets(available, targets, total_tokens))
    full = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    rest = plan.select("source", full.alias("full"), (F.col("budget") - full * F.col("available")).alias("rest"))
    # up to the cut of the last epoch
    one = keyed.join(small(rest), "source")
    got = cut(_prefix(one, ["source"], "n_tokens", sums).where(F.col("upto") <= F.col("rest")).select("doc_id", "source", "n_tokens", "key", "range"))
    used = got.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max(F.struct("range", "key", "doc_id")).alias("last"))
    gaps = cut(rest.join(small(used), "source", "left").select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), "last"))
    # the gap: of the documents behind the cut that fit into it, sizes are chosen from counts of sizes, then documents by their keys
    behind = keyed.where("n_tokens > 0").join(small(gaps), "source").where((F.col("n_tokens") <= F.col("rest")) & (F.col("last").isNull() | (F.struct("range", "key", "doc_id") > F.col("last"))))
    sizes = behind.groupBy("source", "n_tokens").agg(F.count("*").alias("n"), F.max("rest").alias("gap"))
    take = cut(sizes.groupBy("source").applyInPandas(_greedy, "source string, n_tokens long, rest long"))
    n_take = take.count()
    more = behind.drop("rest", "last").join(_broadcast_if(n_take <= FEW)(take), ["source", "n_tokens"]).withColumn("one", F.lit(1))
    more = _prefix(more, ["source", "n_tokens"], "one", _broadcast_if(n_take * ranges <= FEW)).where(F.col("upto") <= F.col("rest")).select("doc_id", "source", "n_tokens", "key", "range")
    last = got.unionByName(more).select("doc_id", "source", "n_tokens", F.lit(1).cast("long").alias("copies"))
    whole = keyed.join(small(rest.where("full > 0").select("source", "full")), "source").select("doc_id", "source", "n_tokens", F.col("full").alias("copies"))
    members = whole.unionByName(last).groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").alias("copies"))
    return members, plan


def report(members: DataFrame, plan: DataFrame) -> DataFrame:
    """The shares reached, from the two results of mix()."""
    got = cut(members.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("epochs")))
    total = got.agg(F.sum("tokens")).first()[0] or 1
    return plan.join(_broadcast_if(got.count() <= FEW)(got), "source", "left").select(
        "source", "target_share", "max_repeats", "available", "budget",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.lit(total), 6).alias("share"),
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
    )


def _greedy(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of which size fill a source's gap: the largest first, as many as fit. So no document that
    is left fits. There is a row per size up to the gap, which is less than one document."""
    gap, out = int(sizes["gap"].iloc[0]) if len(sizes) else 0, []
    for size, n in sizes[["n_tokens", "n"]].sort_values("n_tokens", ascending=False).itertuples(index=False):
        k = min(int(n), gap // int(size))
        if k:
            out.append((sizes["source"].iloc[0], int(size), k))
            gap -= k * int(size)
    return pd.DataFrame(out, columns=["source", "n_tokens", "rest"])


def _prefix(rows: DataFrame, group: list[str], amount: str, sized) -> DataFrame:
    """rows with upto: the amounts of the group up to and with the row, in the order of the key; without the ranges
    that begin beyond the group's rest, of which no row can be taken."""
    sums = rows.groupBy(*group, "range").agg(F.sum(amount).alias("sum"), F.max("rest").alias("rest"))
    before = W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("start <= rest").select(*group, "range", "start")
    inner = W.partitionBy(*group, "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(sized(starts), [*group, "range"]).withColumn("upto", F.col("start") + F.sum(amount).over(inner))


def _broadcast_if(few: bool):
    """A side is broadcast only if its rows are known to be few; else the join is left to the planner."""
    return F.broadcast if few else (lambda df: df)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    batch_rows(spark, 2000)
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select("doc_id", "source", "text")
    return with_counts(spread(docs), "text", ["doc_id", "source"]), table(spark, sf_dir, "mix_targets")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_inputs(spark, sf_dir))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*mix(*_inputs(spark, sf_dir)))
