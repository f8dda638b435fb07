"""Places of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row in ``order`` among those of equal ``by``; nulls are equal. Without ``by``, among all.

    Rows are dealt to ranges of (by, order), so a group of any size is many
    tasks' work; each range is sorted by itself, and its rows are moved on by
    the rows of their group in the ranges before. The ranges are cut into the
    shared folder, as both steps must see the same ones. Rows that ``order``
    leaves equal have different places, in no given order.
    """
    keys = [*by, *order]
    ranges = df.repartitionByRange(*keys) if keys else df
    rows = cut(ranges.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    stats = rows.groupBy(*by, part.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row for each range that holds a piece of the group
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    moved = stats.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_move"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = rows.withColumn("_p", part).join(moved, (F.col("_p") == F.col("_q")) & same)
    return out.select(*df.columns, (F.col("_at") + F.col("_move")).alias(name))
