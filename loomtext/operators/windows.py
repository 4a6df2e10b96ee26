"""Intervals and runs over ordered rows, as window expressions.

Every window is partitioned by a key that is bounded by nature (a file, a document, an order); none
runs over the whole table. numbered() is for keys without such a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.session import cut


def islands(df: DataFrame, keys: list[str], number: str, text: str | None = None, head: int | None = None) -> DataFrame:
    """Runs of consecutive numbers per key: start_line, end_line, n_lines and, with text, texts in
    order; with head only the first so many of each run are gathered. A number that occurs twice counts once;
    null numbers are dropped."""
    rows = df.where(F.col(number).isNotNull()).dropDuplicates([*keys, number])
    run = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    rows = rows.withColumn("__run", run)
    aggs = [F.min(number).alias("start_line"), F.max(number).alias("end_line"), F.count("*").alias("n_lines")]
    if text:
        pair = F.struct(F.col(number).alias("n"), F.col(text).alias("t"))
        if head is not None:
            rows = rows.withColumn("__at", F.row_number().over(W.partitionBy(*keys, "__run").orderBy(number)))
            pair = F.when(F.col("__at") <= head, pair)
        aggs.append(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]).alias("texts"))
    return rows.groupBy(*keys, "__run").agg(*aggs).drop("__run")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, text: str | None = None) -> DataFrame:
    """Touching and overlapping intervals per key as one: start, end, n, and the texts joined in
    the order of start, end, text."""
    order = [start, end, *([text] if text else [])]
    w = W.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    g = df.withColumn("__new", new).withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")]
    if text:
        parts = F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.col(text).alias("t"))))
        aggs.append(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(text))
    return g.groupBy(*keys, "__g").agg(*aggs).drop("__g")


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows that begin before their predecessor ends, with prev_end."""
    w = W.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("prev_end", F.lag(end).over(w)).where(F.col("prev_end") > F.col(start))


def shifted(df: DataFrame, keys: list[str], start: str, delta: str) -> DataFrame:
    """new_start: the start after the length changes of all earlier rows of the key."""
    w = W.partitionBy(*keys).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("new_start", F.col(start) + F.coalesce(F.sum(delta).over(w), F.lit(0)))


def length_change(old: Column, new: Column) -> Column:
    return F.octet_length(new) - F.octet_length(old)


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based place of each row within its key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """0-based place of each row within its key, for keys that may hold a great part of all rows.

    The rows are range-partitioned by key and order and checkpointed, so that a key lies in as many
    partitions as it needs; the rows of each (partition, key) are counted, the counts are summed up
    along the partitions, and rows are numbered within a partition only. The rows should be unique in
    keys and order; ties are numbered in any order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = W.partitionBy(*keys, "__p").orderBy(*order)
    rows = parts.withColumn("__i", F.row_number().over(inner) - 1).join(starts, same)
    return rows.withColumn(name, F.col("__s") + F.col("__i")).select(*df.columns, name)
