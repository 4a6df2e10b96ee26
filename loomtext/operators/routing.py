"""Choice of providers for texts, as joins and deterministic schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.scalars import valid_key
from loomtext.operators.windows import numbered

SCHEMA = "id string, model string, rate int, max_input_chars int, api_key string, enabled boolean"


def expand_models(configs: DataFrame) -> DataFrame:
    """One row per model of each provider's models array; the id becomes id/model where there are several."""
    e = configs.withColumn("model", F.explode("models"))
    return e.withColumn("id", F.when(F.size("models") > 1, F.concat_ws("/", "id", "model")).otherwise(F.col("id"))).drop("models")


def usable(providers: DataFrame) -> DataFrame:
    """Enabled providers with a real key and a model."""
    return providers.where(F.col("enabled") & valid_key(F.col("api_key")) & ~F.lower("api_key").contains("your") & (F.coalesce("model", F.lit("")) != ""))


def duplicate_ids(providers: DataFrame) -> DataFrame:
    return providers.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def capacity(providers: DataFrame) -> DataFrame:
    """Least positive and greatest capacity of all providers."""
    c = F.col("max_input_chars")
    return providers.agg(F.min(F.when(c > 0, c)).alias("threshold"), F.max(c).alias("max_capacity"))


def capable(texts: DataFrame, providers: list[tuple[str, int]], text: str = "text") -> DataFrame:
    """texts with the array of the providers that can take them (a capacity of 0 takes all).
    Providers are a configuration of a few rows, so the theta join is an expression."""
    n = F.octet_length(text)
    ids = F.array_compact(F.array(*[F.when((F.lit(c) == 0) | (n <= c), F.lit(i)) for i, c in providers]))
    return texts.withColumn("capable", F.when(F.col(text).isNotNull(), ids))


def schedule(weights: dict[str, int]) -> list[str]:
    """Smooth weighted turns: each id as often as its weight, spread evenly. Ids with a weight of
    0 or less don't take part."""
    slots = [((k + 0.5) / w, -w, i) for i, w in weights.items() if w > 0 for k in range(w)]
    return [i for *_, i in sorted(slots)]


def weighted(n: Column, weights: dict[str, int]) -> Column:
    """Provider of the n-th text by the smooth schedule."""
    order = schedule(weights)
    return F.element_at(F.array(*map(F.lit, order)), F.pmod(n, F.lit(len(order))).cast("int") + 1)


def round_robin(n: Column, ids: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, ids)), F.pmod(n, F.lit(len(ids))).cast("int") + 1)


def weighted_random(key: Column, weights: dict[str, int], seed: int = 0) -> Column:
    """Provider by chance in proportion to the weights; the same key always has the same one."""
    total = sum(w for w in weights.values() if w > 0)
    x = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(total))
    out, upto = F.when(F.lit(False), F.lit("")), 0
    for i, w in weights.items():
        if w > 0:
            upto += w
            out = out.when(x < upto, i)
    return out


#: Kinds of translators, the preferred first.
PRIORITY = {"deeplx": 1, "tencent": 2, "llm": 3}


def preferred(translators: DataFrame) -> DataFrame:
    """The translator to use: healthy ones by kind, then by id; if none is healthy any, by the same order."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")], F.lit(9))
    return translators.agg(F.min_by("id", F.struct((~F.col("healthy")).cast("int").alias("h"), rank.alias("r"), F.col("id"))).alias("id"))


def batches(df: DataFrame, order: list[str], size: int, keys: list[str]) -> DataFrame:
    """batch: number of the fixed-size batch of each row within its keys, whatever their sizes."""
    return numbered(df, keys, order, "__no").withColumn("batch", F.floor(F.col("__no") / size)).drop("__no")


def router_stats(providers: DataFrame) -> DataFrame:
    """One JSON summary of the providers, by id."""
    rows = F.array_sort(F.collect_list(F.struct("id", "model", "rate", "max_input_chars")))
    return providers.agg(F.to_json(F.struct(F.count("*").alias("total"), rows.alias("providers"))).alias("stats"))


def failover_order(ids: list[str], failed: str, retries: int) -> list[str]:
    return [i for i in ids if i != failed][:retries]


def _steps(down: int, up: int) -> tuple[list[int], list[int]]:
    """Next states after a failure and after a success. States 0 to down - 1: healthy with so many
    failures; from down on: unhealthy with so many successes."""
    fail = [i + 1 for i in range(down)] + [down + i for i in range(up)]
    good = list(range(down)) + [down + i + 1 for i in range(up - 1)] + [0]
    return fail, good


def health(events: DataFrame, keys: list[str], order: list[str], down: int = 3, up: int = 2) -> DataFrame:
    """Final state per provider after its events (success boolean, null as a failure), in order:
    down failures make it unhealthy, up successes healthy again; the counters start anew with each change.

    An event is a function on down + up states and functions compose, so each range of a provider's
    events is composed on its own, and only one function per range is applied in order.
    """
    fail, good = _steps(down, up)
    first = list(range(down + up))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(*keys, *order, F.coalesce("success", F.lit(False)).alias("success"))
    ordered = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__p", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*keys).schema)

    def composed(frames):
        key, state, part = None, first, 0
        for pdf in frames:
            for *k, ok, p in pdf.itertuples(index=False, name=None):
                if k != key:
                    if key is not None:
                        yield pd.DataFrame([[*key, part, state]], columns=[*keys, "__p", "__f"])
                    key, state = k, first
                step, part = good if ok else fail, p
                state = [step[x] for x in state]
        if key is not None:
            yield pd.DataFrame([[*key, part, state]], columns=[*keys, "__p", "__f"])

    ranges = ordered.select(*keys, "success", "__p").mapInPandas(composed, f"{kinds}, `__p` int, `__f` array<int>")
    listed = F.array_sort(F.collect_list(F.struct("__p", "__f")))  # at most one per partition
    return ranges.groupBy(*keys).agg(listed.alias("__r")).select(*keys, (F.aggregate("__r", F.lit(0), lambda s, r: F.get(r["__f"], s)) < down).alias("healthy"))
