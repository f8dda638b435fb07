"""Queries of token windows and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import pack
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_PACK = f"""st AS (SELECT source, doc_id, list_append(list_transform({_W}, lambda w: length(w)::INT), 0) AS t FROM documents),
tk AS (SELECT source, doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok FROM st),
ps AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS p FROM tk),
wn AS (SELECT source, p // 1024 AS window_id, list(tok ORDER BY p) AS tokens FROM ps GROUP BY source, p // 1024 HAVING count(*) = 1024)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Words' lengths stand for their ids, so that SQL can follow."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.transform(T.words(T.text_of(F.col("text"))), F.length).alias("ids"))
    return pack.windows(docs, ["source"], "doc_id", "ids")


@query(f"WITH {_PACK} SELECT source, window_id, CASE WHEN window_id % 100 = 0 THEN 'val' ELSE 'train' END AS split, tokens FROM wn")
def pack_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


@query(f"WITH {_PACK}, s AS (SELECT source, count(*) FILTER (window_id % 100 <> 0) AS train_windows, count(*) FILTER (window_id % 100 = 0) AS val_windows FROM wn GROUP BY ROLLUP (source)) SELECT *, train_windows * 1024 AS train_tokens, val_windows * 1024 AS val_tokens FROM s")
def window_index(spark: SparkSession, d: str) -> DataFrame:
    return pack.index(_windows(spark, d), ["source"])


@query(f"WITH {_PACK} SELECT count(*) FILTER (len(tokens) <> 1024) AS wrong_length, count(*) FILTER (list_max(tokens) >= 16384) AS outside_vocabulary, count(*) FILTER (window_id < 0) AS negative, (count(*) * 2048)::BIGINT AS bytes, max(list_max(tokens))::BIGINT AS largest FROM wn")
def window_verify(spark: SparkSession, d: str) -> DataFrame:
    """What a corpus check looks at: lengths, ids, bytes of two-byte ids."""
    w = _windows(spark, d)
    return w.agg(F.count_if(F.size("tokens") != 1024).alias("wrong_length"), F.count_if(F.array_max("tokens") >= 16384).alias("outside_vocabulary"), F.count_if(F.col("window_id") < 0).alias("negative"), (F.count("*") * 2048).alias("bytes"), F.max(F.array_max("tokens")).cast("bigint").alias("largest"))


_VALID = "v AS (SELECT * FROM token_index WHERE train_tokens IS NOT NULL QUALIFY row_number() OVER (PARTITION BY build_id, source, shard ORDER BY written_at DESC, train_tokens DESC) = 1)"


def _valid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "token_index").where("train_tokens IS NOT NULL")
    last = F.max_by(F.struct("train_windows", "val_windows", "train_tokens", "val_tokens"), F.struct("written_at", "train_tokens")).alias("v")
    return t.groupBy("build_id", "source", "shard").agg(last).select("build_id", "source", "shard", "v.*")


@query(f"WITH {_VALID} SELECT build_id, source, sum(train_windows)::BIGINT AS train_windows, sum(train_tokens)::BIGINT AS train_tokens, sum(val_tokens)::BIGINT AS val_tokens FROM v GROUP BY ROLLUP (build_id, source)")
def token_index(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each build and source with their totals; the row latest written of each shard counts."""
    return _valid(spark, d).rollup("build_id", "source").agg(F.sum("train_windows").alias("train_windows"), F.sum("train_tokens").alias("train_tokens"), F.sum("val_tokens").alias("val_tokens"))


@query(f"WITH {_VALID}, g AS (SELECT build_id, source, sum(train_tokens)::BIGINT AS tokens FROM v GROUP BY build_id, source) SELECT build_id, source, tokens, round(tokens::DOUBLE / sum(tokens) OVER (PARTITION BY build_id), 6) AS share FROM g")
def build_shares(spark: SparkSession, d: str) -> DataFrame:
    g = _valid(spark, d).groupBy("build_id", "source").agg(F.sum("train_tokens").alias("tokens"))
    return g.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("build_id")), 6))


@query(f"WITH {_VALID} SELECT build_id, max(train_windows)::BIGINT AS slowest, arg_max(shard, (train_windows, source, shard)) AS shard, count(*) FILTER (val_windows <> ceil((train_windows + val_windows) / 100.0)) AS off FROM v GROUP BY build_id")
def slowest_shard(spark: SparkSession, d: str) -> DataFrame:
    """The largest shard of each build, and how many shards miss the closed form of the split."""
    off = F.col("val_windows") != F.ceil((F.col("train_windows") + F.col("val_windows")) / F.lit(100.0))
    return _valid(spark, d).groupBy("build_id").agg(F.max("train_windows").alias("slowest"), F.max_by("shard", F.struct("train_windows", "source", "shard")).alias("shard"), F.count_if(off).alias("off"))


@query("SELECT source, sum(n_tokens)::BIGINT AS real, (sum(ceil(n_tokens / 1024.0)) * 1024)::BIGINT AS padded, round(sum(n_tokens)::DOUBLE / (sum(ceil(n_tokens / 1024.0)) * 1024), 6) AS used FROM (SELECT DISTINCT id, source, n_tokens FROM passage) WHERE n_tokens > 0 GROUP BY source")
def padding_use(spark: SparkSession, d: str) -> DataFrame:
    """How much of padded rows would be real tokens."""
    p = table(spark, d, "passage").select("id", "source", "n_tokens").distinct().where("n_tokens > 0")
    padded = (F.sum(F.ceil(F.col("n_tokens") / F.lit(1024.0))) * 1024).cast("bigint")
    return p.groupBy("source").agg(F.sum("n_tokens").alias("real"), padded.alias("padded"), F.round(F.sum("n_tokens") / padded, 6).alias("used"))


@query("SELECT source, round(sum(length(text))::DOUBLE / sum(n_tokens), 6) AS chars_per_token FROM (SELECT DISTINCT id, source, text, n_tokens FROM passage) WHERE n_tokens > 0 AND text IS NOT NULL GROUP BY source")
def fertility(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passage").select("id", "source", F.length("text").alias("c"), "n_tokens").where("n_tokens > 0 AND c IS NOT NULL").distinct()
    return p.groupBy("source").agg(F.round(F.sum("c") / F.sum("n_tokens"), 6).alias("chars_per_token"))
