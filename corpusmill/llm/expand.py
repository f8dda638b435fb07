"""Pairs of rows from pairs of classes, where a class may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parts(members: DataFrame, part: int) -> DataFrame:
    """``c`` and ``parts`` of the classes that are dealt to more than one part."""
    return members.groupBy("c").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")


def _dealt(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``c``, ``k`` and the part ``p`` of its class that holds the row."""
    p = F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1)))
    return members.join(parts, "c", "left").select("c", "k", p.alias("p"))


def _all_parts(df: DataFrame, parts: DataFrame, c: str) -> DataFrame:
    """Each row once for each part of its class ``c``, named in ``p``."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))
    return df.join(parts.withColumnRenamed("c", c), c, "left").select(*df.columns, every.alias("p"))


def to_rows(df: DataFrame, members: DataFrame, cs: list[str], part: int) -> DataFrame:
    """``df`` with the rows of ``members`` (c, k) in the classes that its columns ``cs`` name, as ``k`` and that name. No join key holds more than about ``part`` rows of a class."""
    parts = _parts(members, part)
    dealt = _dealt(members, parts)
    for c in cs:
        df = _all_parts(df, parts, c).join(dealt.select(F.col("c").alias(c), F.col("k").alias(f"k{c}"), "p"), [c, "p"]).drop("p")
    return df


def between(links: DataFrame, members: DataFrame, part: int) -> DataFrame:
    """``ka``, ``kb``: all rows of ``members`` (c, k) in the classes of each link (a, b)."""
    return to_rows(links.select("a", "b"), members, ["a", "b"], part).select("ka", "kb")


def within(members: DataFrame, part: int) -> DataFrame:
    """``ka`` < ``kb``: all pairs of rows of one class of ``members`` (c, k)."""
    parts = _parts(members, part)
    a = _all_parts(members.select("c", F.col("k").alias("ka")), parts, "c")
    return a.join(_dealt(members, parts).withColumnRenamed("k", "kb"), ["c", "p"]).where("ka < kb").select("ka", "kb")
