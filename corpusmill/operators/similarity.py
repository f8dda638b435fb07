"""Vectors: norms, cosines, and pairs of similar ones by blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut, ship

FLOOR = 1e-8


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; lengths are held above 1e-8."""
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR)


def against(df: DataFrame, key: str, vector: str, held: DataFrame, held_vector: str, part_mb: float = 64) -> DataFrame:
    """``key`` and ``best``: each row's largest cosine with a fixed set of vectors, by matrix products on Arrow batches.

    The set (say, held-out questions) is sent to the workers in parts of about
    ``part_mb``; each part is one more pass over the rows, which are not
    shuffled. Rows without a vector are left out; an empty set gives null.
    """
    ship(df.sparkSession)
    rows = held.where(F.col(held_vector).isNotNull()).select(F.col(held_vector).alias("v"))
    width = rows.select(F.size("v")).first()
    parts = max(1, math.ceil(rows.count() * (width[0] if width else 0) * 8 / (part_mb * 1e6)))

    def best_of(fixed: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, best = _matrix(b.column(1)), b.column(2)
                if fixed.size and len(m):
                    best = pa.array(np.fmax((m @ fixed).max(axis=1), best.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), best], ["k", "v", "best"])

        return run

    out = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("best"))
    for i in range(parts):
        fixed = rows.where(F.pmod(F.xxhash64("v"), F.lit(parts)) == i).toArrow().column(0).combine_chunks()
        out = out.mapInArrow(best_of(_matrix(fixed).T), "k bigint, v array<double>, best double")
    return out.select(F.col("k").alias(key), "best")


def pairs(df: DataFrame, key: str, vector: str, least: float, blocks: int | None = None, per_block: int = 4096) -> DataFrame:
    """``a`` < ``b`` and ``cosine`` of all pairs of at least ``least``, exactly, whatever ``least`` is.

    Vectors are dealt to blocks of about ``per_block``; each pair of blocks is
    one group, a matrix product on Arrow data, so no row pairs are made by a
    join and no group grows with the input. Every vector is sent to as many
    groups as there are blocks: the work of an exact answer, meant for sets of
    up to some hundred thousand vectors; ``banded_pairs`` is for larger ones.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))
    n = blocks or max(1, -(-rows.count() // per_block))
    mine = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    sent = rows.withColumn("p", mine).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sent = sent.select("k", "v", "p", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))

    def product(group: pa.Table) -> pa.Table:
        x, y, p = group["x"][0].as_py(), group["y"][0].as_py(), group["p"].to_numpy()
        k, m = group["k"].to_numpy(), _matrix(group["v"].combine_chunks())
        left, right = np.flatnonzero(p == x), np.flatnonzero(p == y)
        c = m[left] @ m[right].T
        i, j = np.nonzero(np.round(c, 6) >= least)
        a, b, s = k[left[i]], k[right[j]], c[i, j]
        keep = a < b if x == y else a != b
        a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": np.round(s, 6)})

    return sent.groupBy("x", "y").applyInArrow(product, "a bigint, b bigint, cosine double")


def banded_pairs(df: DataFrame, key: str, vector: str, least: float, bits: int = 16, bands: int = 48, seed: int = 1) -> DataFrame:
    """As ``pairs``, for sets of any size and a high ``least``: only pairs that agree in a band are compared, exactly.

    A band is the side of ``bits`` random planes on which a vector lies. A pair
    at angle x agrees in a band with probability ``(1 - x / pi) ** bits``, so of
    pairs at cosine 0.92 the default finds 99.6 % (of those at 0.95 all but
    0.002 %). Vectors are moved once for each band; equal vectors are one row
    in the bands, and pairs of them are given.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v"))
    first = cut(rows.groupBy("h").agg(F.min("k").alias("k"), F.first("v").alias("v")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            m = _matrix(b.column(1))
            if not len(m):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], bits * bands))
            side = (m @ planes > 0).reshape(len(m), bands, bits)
            band = (side @ (1 << np.arange(bits, dtype=np.int64))) + (np.arange(bands, dtype=np.int64) << np.int64(bits))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(m)), bands))), pa.array(band.ravel())], ["h", "band"])

    banded = first.select("h", "v").mapInArrow(keys, "h bigint, band bigint")
    x, y = banded.alias("x"), banded.alias("y")
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.h") < F.col("y.h"))).select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb")).distinct()
    both = near.join(first.select(F.col("h").alias("ha"), F.col("v").alias("va")), "ha").join(first.select(F.col("h").alias("hb"), F.col("v").alias("vb")), "hb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.round(np.einsum("ij,ij->i", _matrix(b.column(2)), _matrix(b.column(3))), 6) if b.num_rows else np.zeros(0)
            keep = pa.array(np.flatnonzero(c >= least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(c).take(keep)], ["ha", "hb", "cosine"])

    links = both.select("ha", "hb", "va", "vb").mapInArrow(verify, "ha bigint, hb bigint, cosine double")
    own = first.where(F.round(dot(unit(F.col("v")), unit(F.col("v"))), 6) >= least).select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(1.0).alias("cosine"))
    members = rows.select("h", "k")
    out = links.unionByName(own).join(members.select(F.col("h").alias("ha"), F.col("k").alias("ka")), "ha").join(members.select(F.col("h").alias("hb"), F.col("k").alias("kb")), "hb")
    return out.where((F.col("ha") != F.col("hb")) | (F.col("ka") < F.col("kb"))).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "cosine")


def spread(df: DataFrame, vector: str) -> DataFrame:
    """Mean cosine of all ordered pairs without those of a vector with itself, from one sum of unit vectors: no pair is made.

    ``n``, ``mean`` over the square with a zero diagonal, and ``mean_diagonal`` with it.
    """
    u = df.where(F.col(vector).isNotNull()).select(unit(F.col(vector)).alias("u"))
    sums = u.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    one = sums.agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"), F.max("n").alias("n"))
    sq = F.col("n") * F.col("n")
    return one.select("n", ((F.col("all") - F.col("own")) / sq).alias("mean"), (F.col("all") / sq).alias("mean_diagonal"))
