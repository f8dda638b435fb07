"""Queries of streams: the events stand for a metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import clean
from corpusmill.plans import cleaning  # noqa: F401, its SQL is used here
from corpusmill.plans.registry import SQL, query
from corpusmill.sources.tables import table
from corpusmill.streaming import metrics

_LATEST = "SELECT user_id, count(*) AS rows, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id"
_STALL = """WITH g AS (SELECT user_id, row_number() OVER w AS i, coalesce(value > lag(value) OVER w, true) AS grown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, i, max(CASE WHEN grown THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS last FROM g) SELECT user_id, min(i) AS at FROM l WHERE i - last >= 3 GROUP BY user_id"""


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return metrics.stream(spark, d, name, table(spark, d, name).schema)


@query(_LATEST)
def latest_metric(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each run, kept up to date by a stream."""
    s = metrics.latest(_stream(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return metrics.drained(s, "complete")


@query(_STALL)
def stall_detect(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stalls(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query(_STALL)
def stall_detect_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with the state of each run."""
    return metrics.drained(metrics.stalls_stream(_stream(spark, d, "events"), "user_id", ["ts", "event_id"], "value"), "append")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS rows, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_metric(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of the log, updated as rows arrive; state older than the watermark is let go."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("mean"))
    return metrics.drained(g.select(F.col("w.start").alias("hour"), "event_type", "rows", "mean"), "update", keys=["hour", "event_type"]).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(SQL["clean_disposition"])
def clean_stream(spark: SparkSession, d: str) -> DataFrame:
    """The cleaning chain on newly arriving shards: it needs no state."""
    s = clean.disposition(_stream(spark, d, "documents").select("doc_id", "source", "text"))
    return metrics.drained(s.select("doc_id", "source", "reason", F.col("raw_chars").cast("bigint"), F.col("clean_chars").cast("bigint"), F.md5("clean_text").alias("hash")), "append")
