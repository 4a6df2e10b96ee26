"""p6: filling containers by vector bin packing with the dot-product heuristic.

An item is a vector (p6_batches: texts and characters; p6_examples: tokens, segments and loss-bearing
tokens), a container a vector of
capacities. A container is opened and takes, as long as anything fits, the item whose
vector has the greatest dot product with what is left of the container, each dimension
weighted by how scarce it is. Items with equal vectors are one class with a count, so a step
looks at classes, not at items. The plain product prefers large items; where the number of
texts is the scarce dimension, the dot product over the item's length fills better. Each
shard is packed by three such rules and the packing with the fewest containers is kept.

A group that holds a third of all rows isn't packed in one task: groups are cut by hash into
shards of about SHARD items, each packed on its own. What that costs is at most one
part-filled container per shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.chunking import split
from loomtext.llm.tokens import with_counts
from loomtext.session import batch_rows, cut, parallelism, spread, table

SHARD = 5000

#: The dimensions of p6_batches: the policies limit texts and characters, nothing else.
DIMS = ["texts", "chars"]
CAPS = ["batch_size", "max_char_count"]

#: Limits of an example of p6_examples: tokens, segments, and tokens that bear loss (those of the answers).
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 24, 400
#: Pairs of a shard: nearly all have a vector of their own, so a step scans as many classes as a shard has pairs.
EXAMPLE_SHARD = 2000


def _fill(vectors: np.ndarray, counts: np.ndarray, cap: np.ndarray, rule: str) -> list[list[int]]:
    """Containers as lists of class numbers.

    rule: product - the plain dot product; cosine - the dot product over the item's length,
    so that direction decides; adaptive - product while the scarcest dimension tells items
    apart, else the cosine with the room alone. Classes that don't fit any more leave the scan of a container,
    as its room only shrinks.
    """
    v = vectors / cap
    left = counts.copy()
    weight = (v * left[:, None]).sum(axis=0)  # demand in containers, by dimension
    order = np.argsort(-(v * weight).sum(axis=1), kind="stable")
    v, left = v[order], left[order]
    plain = np.sqrt((v * v).sum(axis=1)) + 1e-12
    flat = np.ptp(v, axis=0) < 1e-12
    alive = np.arange(len(v))
    demand = weight.copy()
    out = []
    while len(alive):
        room, box = np.ones(v.shape[1]), []
        even = rule == "adaptive" and flat[int(np.argmax(demand))]
        w = demand / max(demand.max(), 1e-12)
        k = int(np.argmax(v[alive] @ w))  # a container opens with the largest item
        if (v[alive[k]] > 1 + 1e-9).any():
            fit = np.flatnonzero((v[alive] <= 1 + 1e-9).all(axis=1))
            k = int(fit[np.argmax(v[alive[fit]] @ w)]) if len(fit) else 0  # an item above capacity is alone, at last
        here, near = alive, None
        while True:
            c = here[k]
            box.append(int(order[c]))
            left[c] -= 1
            room, demand = room - v[c], demand - v[c]
            here = here[(v[here] <= room + 1e-9).all(axis=1) & (left[here] > 0)]
            if not len(here):
                break
            near = v[here]
            if rule == "product" or (rule == "adaptive" and not even):
                score = near @ (w * room)
            elif rule == "adaptive":
                score = (near @ room) / plain[here]
            else:
                score = (near @ (w * room)) / (np.sqrt((near * near) @ w) + 1e-12)
            k = int(np.argmax(score))
        out.append(box)
        alive = alive[left[alive] > 0]
    return out


def pack(items: list[tuple], caps: tuple) -> list[int]:
    """Container number of each item. items: vectors with one number per capacity; items of
    equal vectors are taken in their order. An item above a capacity is alone."""
    if not items:
        return []
    a = np.asarray(items, dtype=float).reshape(len(items), len(caps))
    cap = np.maximum(np.asarray(caps, dtype=float), 1e-9)
    classes, which = np.unique(a, axis=0, return_inverse=True)
    which = which.reshape(-1)
    counts = np.bincount(which, minlength=len(classes))
    best = min((_fill(classes, counts, cap, rule) for rule in ("product", "cosine", "adaptive")), key=len)
    queue: dict[int, list[int]] = {}
    for i in range(len(items) - 1, -1, -1):
        queue.setdefault(int(which[i]), []).append(i)
    out = [0] * len(items)
    for n, box in enumerate(best):
        for c in box:
            out[queue[c].pop()] = n
    return out


def pack_groups(items: DataFrame, group: str, item: str, dims: list[str], caps: list[str], shard: int = SHARD) -> DataFrame:
    """(group, item, container): items packed within each group. dims are the item's numbers,
    caps columns with the group's capacities (equal within the group). container is a string
    unique over all groups. Null numbers count as 0; items with a null group are one group. The
    items (numbers only) are checkpointed, as they are counted before they are packed.
    """
    items = cut(items.select(group, item, *dims, *caps))
    g = items.groupBy(group).agg(F.ceil(F.count("*") / shard).cast("int").alias("__n"))
    rows = items.join(g.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    rows = rows.withColumn("__s", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    kind = {f.name: f.dataType.simpleString() for f in items.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable")
        cap = tuple(float(pdf[c].iloc[0]) for c in caps)
        no = pack([tuple(r) for r in pdf[dims].fillna(0).itertuples(index=False)], cap)
        s = int(pdf["__s"].iloc[0])
        return pd.DataFrame({group: pdf[group].values, item: pdf[item].values, "container": [f"{s}-{n}" for n in no]})

    # a number of partitions of its own, so that many small shards aren't coalesced into few tasks
    rows = rows.select(group, item, *dims, *caps, "__s").repartition(tasks(items.sparkSession), group, "__s")
    out = rows.groupBy(group, "__s").applyInPandas(run, f"`{group}` {kind[group]}, `{item}` {kind[item]}, container string")
    return out.withColumn("container", F.concat_ws("/", F.coalesce(F.col(group).cast("string"), F.lit("")), "container"))


def tasks(spark: SparkSession) -> int:
    return max(3 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all requests: (config_hash, item_key, request_id, part, chars, texts, batch_size,
    max_char_count).

    One row per request_id and config, the delivery ingested first; null texts make no item
    (there is nothing to send), empty and blank ones do. A text longer than max_char_count is
    divided at natural boundaries into parts of at most that many characters.
    """
    req = table(spark, sf_dir, "translate_requests").select("request_id", "config_hash", "text", "ingested_at")
    conf = table(spark, sf_dir, "translate_configs").select("config_hash", "policy_id", "batch_size").dropDuplicates(["config_hash"])
    pol = table(spark, sf_dir, "limit_policies").select("policy_id", "max_char_count").dropDuplicates(["policy_id"])
    rules = conf.join(pol, "policy_id").drop("policy_id")
    rows = req.where(F.col("request_id").isNotNull() & F.col("text").isNotNull()).join(rules, "config_hash")

    @F.pandas_udf("array<int>")
    def sizes(text: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [e - s for s, e, _ in split(t, int(m))] for t, m in zip(text, limit)], dtype=object)

    n = F.length("text")
    long = F.when(n > F.col("max_char_count"), F.col("text"))  # only these are handed to Python
    sized = rows.withColumn("parts", sizes(long, "max_char_count")).select(
        "request_id", "config_hash", "ingested_at", "batch_size", "max_char_count", F.coalesce("parts", F.array(n)).alias("sizes")
    )
    one = sized.groupBy("request_id", "config_hash").agg(
        F.min_by(F.struct("sizes", "batch_size", "max_char_count"), F.struct("ingested_at", "sizes")).alias("r")
    )
    return one.select("config_hash", "request_id", F.posexplode("r.sizes").alias("part", "chars"), "r.batch_size", "r.max_char_count").select(
        "config_hash", F.concat_ws(":", "request_id", "part").alias("item_key"), "request_id", "part", "chars",
        F.lit(1).alias("texts"), F.greatest("batch_size", F.lit(1)).alias("batch_size"), "max_char_count",
    )


def example_items(spark: SparkSession, sf_dir: str, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> DataFrame:
    """Instruction data: (target_lang, response_id, n_tokens, segments, loss_tokens and the limits) of every pair.

    A pair is a successful response with both texts; of one response_id the first by ts counts, ties by the
    sizes. Its tokens are those of both texts by byte_bpe_50k, its loss-bearing tokens those of the answer.
    Labels of the language are only trimmed and lowered; a null label is a group of its own.
    """
    batch_rows(spark, 2000)
    r = table(spark, sf_dir, "translate_responses").where(F.col("response_id").isNotNull() & F.col("original_text").isNotNull() & F.col("translated_text").isNotNull() & F.col("success"))
    r = spread(r.select("response_id", "ts", F.lower(F.trim("target_lang")).alias("target_lang"), "original_text", "translated_text"))
    n = with_counts(r, ["original_text", "translated_text"], ["response_id", "ts", "target_lang"]).withColumnsRenamed({"n_tokens_0": "n_tokens", "n_tokens_1": "loss_tokens"})
    one = n.groupBy("response_id").agg(F.min_by(F.struct("target_lang", (F.col("n_tokens") + F.col("loss_tokens")).alias("n_tokens"), "loss_tokens"), F.struct("ts", "n_tokens", "loss_tokens", "target_lang")).alias("r"))
    return one.select("r.target_lang", "response_id", "r.n_tokens", F.lit(1).alias("segments"), "r.loss_tokens", F.lit(tokens).alias("max_tokens"), F.lit(segments).alias("max_segments"), F.lit(loss).alias("max_loss"))


def p6_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_lang, response_id, example): pairs packed into training examples under simultaneous limits on
    tokens, segments and loss-bearing tokens. A pair above a limit is an example of its own; pairs are never divided."""
    packed = pack_groups(example_items(spark, sf_dir), "target_lang", "response_id", ["n_tokens", "segments", "loss_tokens"], ["max_tokens", "max_segments", "max_loss"], EXAMPLE_SHARD)
    return packed.withColumnRenamed("container", "example")


def p6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_hash, request_id, part, chars, batch): every text or part in its batch."""
    items = batch_items(spark, sf_dir)
    packed = pack_groups(items, "config_hash", "item_key", DIMS, CAPS)
    key = F.split("item_key", ":")
    return packed.select("config_hash", key[0].cast("long").alias("request_id"), key[1].cast("int").alias("part"), F.col("container").alias("batch"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per config: texts, characters, batches, and the least number any packing could have."""
    items = cut(batch_items(spark, sf_dir))
    packed = pack_groups(items, "config_hash", "item_key", DIMS, CAPS)
    n = packed.groupBy("config_hash").agg(F.countDistinct("container").alias("batches"))
    load = items.groupBy("config_hash").agg(
        F.count("*").alias("texts"), F.sum("chars").alias("chars"),
        F.greatest(F.ceil(F.count("*") / F.max("batch_size")), F.ceil(F.sum("chars") / F.max("max_char_count"))).alias("least_batches"),
    )
    return load.join(n, "config_hash")
