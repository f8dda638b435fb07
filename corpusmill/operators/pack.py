"""Token windows of fixed length, cut from the running stream of each shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ, EVERY = 1024, 100
#: Documents in order whose lengths one task sums.
STRETCH = 10_000


def windows(df: DataFrame, shard: list[str], order: str, ids: str, length: int = SEQ, eos: int = 0, every: int = EVERY) -> DataFrame:
    """shard columns, ``window_id``, ``split`` and ``tokens``: each document's ids and ``eos``, cut into full windows; the rest of a shard is dropped.

    Documents get their place by a running sum of lengths in two levels, over
    stretches of ``STRETCH`` in ``order`` (a number) and inside each, so that no
    shard is one task's work. Ids are then cut where windows begin, and each is
    shuffled once, in slices.
    """
    doc = df.select(*shard, F.col(order).alias("_o"), F.concat(F.coalesce(F.col(ids), F.array().cast("array<int>")), F.array(F.lit(eos))).alias("_t"))
    doc = doc.withColumn("_n", F.size("_t").cast("bigint"))
    doc = doc.withColumn("_b", F.floor(F.col("_o") / STRETCH))
    zero = F.lit(0).cast("bigint")
    sums = doc.groupBy(*shard, "_b").agg(F.sum("_n").alias("_s"))
    past = Window.partitionBy(*shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*shard, "_b", F.coalesce(F.sum("_s").over(past), zero).alias("_past"))
    before = Window.partitionBy(*shard, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    at = doc.withColumn("_here", F.coalesce(F.sum("_n").over(before), zero)).join(sums, [*shard, "_b"]).withColumn("_at", F.col("_past") + F.col("_here"))
    w = F.explode(F.sequence(F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("_n") - 1) / length))).alias("window_id")
    part = at.select(*shard, "_at", "_t", "_n", w)
    start = F.greatest(F.col("window_id") * length - F.col("_at"), F.lit(0).cast("bigint"))
    end = F.least((F.col("window_id") + 1) * length - F.col("_at"), F.col("_n"))
    cut = part.select(*shard, "window_id", (F.col("_at") + start).alias("_p"), F.slice("_t", (start + 1).cast("int"), (end - start).cast("int")).alias("_s"))
    whole = cut.groupBy(*shard, "window_id").agg(F.sort_array(F.collect_list(F.struct("_p", "_s"))).alias("_l"))
    tokens = F.flatten(F.transform("_l", lambda x: x["_s"]))
    out = whole.select(*shard, "window_id", F.when(F.col("window_id") % every == 0, "val").otherwise("train").alias("split"), tokens.alias("tokens"))
    return out.where(F.size("tokens") == length)


def index(wins: DataFrame, shard: list[str], length: int = SEQ) -> DataFrame:
    """Windows and tokens of each shard and of all, the row of nulls, by split."""
    n = lambda s: F.count_if(F.col("split") == s)
    return wins.rollup(*shard).agg(n("train").alias("train_windows"), n("val").alias("val_windows"), (n("train") * length).alias("train_tokens"), (n("val") * length).alias("val_tokens"))
