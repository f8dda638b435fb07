"""Figures of evaluations from tables of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perplexity(df: DataFrame, by: str, loss: str, n: str) -> DataFrame:
    """``loss`` weighted by ``n`` and its perplexity (of at most 20) for each part and for all (null), in one pass."""
    r = df.rollup(by).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"), F.sum(n).alias("n"))
    return r.withColumn("perplexity", F.exp(F.least(F.col("loss"), F.lit(20.0))))


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """``c``, hits, predicted, support, precision, recall and f1 of each class that occurs; 0 where a denominator is 0.

    One aggregation over both labels of each row, not three joined ones.
    """
    long = df.select(F.inline(F.array(F.struct(F.col(true).alias("c"), (F.col(true) == F.col(pred)).cast("bigint").alias("hit"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("t"), F.lit(1).alias("p")))))
    g = long.groupBy("c").agg(F.sum("hit").alias("hits"), F.sum("p").alias("predicted"), F.sum("t").alias("support"))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    g = g.withColumns({"precision": p, "recall": r})
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro(classes: DataFrame, top: int = 100, rare: int = 10) -> DataFrame:
    """Micro and macro figures of ``per_class``: over classes present, the ``top`` by support, and the rare ones."""
    here = F.col("support") > 0
    first = classes.orderBy(F.desc("support"), "c").limit(top).select("c").withColumn("top", F.lit(True))
    x = classes.join(first, "c", "left")
    avg = lambda c, on: F.round(F.avg(F.when(on, F.col(c))), 6)
    return x.agg(
        F.count_if(here).alias("present"), F.count_if(here & (F.col("predicted") == 0)).alias("never_predicted"), F.round(F.sum("hits") / F.sum("support"), 6).alias("micro"),
        avg("precision", here).alias("macro_precision"), avg("recall", here).alias("macro_recall"), avg("f1", here).alias("macro_f1"),
        avg("precision", F.col("top")).alias("top_precision"), avg("recall", F.col("top")).alias("top_recall"),
        F.count_if(here & (F.col("support") < rare)).alias("rare"), avg("recall", here & (F.col("support") < rare)).alias("rare_recall"), F.round(F.sum(F.when(F.col("top"), F.col("support"))) / F.sum("support"), 6).alias("top_share"),
    )


def top_tokens(df: DataFrame, by: str, token: str, logit: str, k: int) -> DataFrame:
    """The ``k`` most probable tokens of each prompt by softmax; k is held between 1 and 50."""
    of = Window.partitionBy(by)
    e = F.exp(F.col(logit) - F.max(logit).over(of))
    p = df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(of))
    return p.withColumn("_r", F.row_number().over(of.orderBy(F.desc("p"), token))).where(F.col("_r") <= max(1, min(50, k))).select(by, token, "p")
