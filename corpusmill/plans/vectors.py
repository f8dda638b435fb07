"""Queries of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import dedup, similarity
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

_U = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS v FROM embeddings WHERE embedding IS NOT NULL)"
#: At the thresholds of the original rule (0.92 and 0.88) no pair of these vectors is similar.
NEAR, CLOSE = 0.40, 0.35


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"WITH {_U} SELECT vec_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm FROM u")
def embedding_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).where("embedding IS NOT NULL").select("vec_id", similarity.unit(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(similarity.dot(F.col("v"), F.col("v")), 6).alias("norm"))


_PAIRS = f"{_U}, pr AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 6) >= {NEAR})"


@query(f"WITH {_PAIRS} SELECT a, b, cosine FROM pr")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pairs(_vectors(spark, d), "vec_id", "embedding", NEAR)


#: A set with pairs as like as the original rule asks: half of the vectors, and each of the others moved a little towards its neighbour.
_MOVED = "m AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE + 0.2::DOUBLE * b.embedding[i]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 UNION ALL SELECT -vec_id - 1, list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings)"


@query(f"WITH {_MOVED}, u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)) AS v FROM m) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id AND round(list_dot_product(a.v, b.v), 6) >= 0.92")
def cosine_banded(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at the original threshold, from bands: the way for sets of any size."""
    v = _vectors(spark, d).select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    moved = v.join(nxt, "vec_id").select("vec_id", F.zip_with("embedding", "next", lambda x, y: x.cast("double") + F.lit(0.2) * y.cast("double")).alias("v"))
    both = moved.unionByName(v.select((-F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    return similarity.banded_pairs(both, "vec_id", "v", 0.92)


@query(f"""WITH RECURSIVE {_PAIRS}, nodes AS (SELECT a AS v FROM pr UNION SELECT b FROM pr), ranked AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM nodes),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT r.i, CASE WHEN EXISTS (SELECT 1 FROM pr p WHERE p.b = r.v AND list_contains(w.kept, p.a)) THEN w.kept ELSE list_append(w.kept, r.v) END FROM walk w JOIN ranked r ON r.i = w.i + 1)
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT v FROM nodes WHERE NOT list_contains((SELECT kept FROM walk ORDER BY i DESC LIMIT 1), v))""")
def cosine_dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that a pass in order of ids keeps: each unlike every kept one before it."""
    e = similarity.pairs(_vectors(spark, d), "vec_id", "embedding", NEAR).select(F.col("a").alias("hi"), F.col("b").alias("lo"))
    return _vectors(spark, d).select("vec_id").join(dedup.greedy_drop(e).select(F.col("lo").alias("vec_id")), "vec_id", "left_anti")


@query(f"WITH {_U}, h AS (SELECT v FROM u WHERE label = 0) SELECT vec_id, round(max(list_dot_product(u.v, h.v)), 6) AS best FROM u, h WHERE label <> 0 GROUP BY vec_id")
def max_sim_to_held(spark: SparkSession, d: str) -> DataFrame:
    """The largest cosine of each vector with the held-out ones (label 0)."""
    v = _vectors(spark, d)
    return similarity.against(v.where("label != 0"), "vec_id", "embedding", v.where("label = 0"), "embedding").select("vec_id", F.round("best", 6).alias("best"))


@query(f"WITH {_U}, h AS (SELECT v FROM u WHERE label = 0) SELECT vec_id FROM u WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE round(list_dot_product(u.v, h.v), 6) >= {CLOSE})")
def train_decontam_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are unlike every held-out one."""
    return max_sim_to_held(spark, d).where(F.col("best") < CLOSE).select("vec_id")


@query(f"WITH {_U} SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE list_dot_product(a.v, b.v) END), 6) AS mean, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_diagonal FROM u a, u b".replace("count(*)::BIGINT AS n", "sqrt(count(*))::BIGINT AS n"))
def diversity_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine over the square of pairs, without and with the diagonal, from sums alone."""
    return similarity.spread(_vectors(spark, d), "embedding").select("n", F.round("mean", 6).alias("mean"), F.round("mean_diagonal", 6).alias("mean_diagonal"))


@query(f"WITH {_U}, s AS (SELECT CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE list_dot_product(a.v, b.v) END AS c FROM (SELECT * FROM u ORDER BY vec_id LIMIT 1000) a, (SELECT * FROM u ORDER BY vec_id LIMIT 1000) b) SELECT round(quantile_cont(c, 0.99), 6) AS p99, round(max(c), 6) AS largest FROM s")
def diversity_tail(spark: SparkSession, d: str) -> DataFrame:
    """The 99th percentile and the maximum over a report's sample of 1,000 vectors, the zero diagonal included."""
    v = _vectors(spark, d).where("embedding IS NOT NULL").orderBy("vec_id").limit(1000)
    c = similarity.pairs(v, "vec_id", "embedding", -2.0).select("cosine")
    both = c.withColumn("cosine", F.explode(F.array("cosine", "cosine"))).unionByName(v.select(F.lit(0.0).alias("cosine")))
    return both.agg(F.round(F.percentile("cosine", 0.99), 6).alias("p99"), F.round(F.max("cosine"), 6).alias("largest"))
