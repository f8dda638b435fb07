"""Streams of metric rows: the latest state, stalls, and incremental cleaning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpusmill.sources.tables import scratch

POLLS = 3


def stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A file stream of the tables ``name`` in ``folder``; the schema is given, as streams don't infer it."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(folder)


def drained(df: DataFrame, mode: str, schema=None, keys: list[str] | None = None) -> DataFrame:
    """All there is in the stream now, run to its end, and the result as a table in the shared folder.

    ``append`` writes rows as they are final; ``update`` writes each batch's
    changed rows, of which the last of each of ``keys`` counts; ``complete``
    writes the whole state anew with each batch, of which the last is read.
    """
    spark = df.sparkSession
    at = scratch(spark, "stream")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{at}/out").start()
    elif mode == "update":
        q = w.foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/{i}")).start()
    else:
        q = w.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    if mode == "update":
        values = [c for c in df.columns if c not in keys]
        rows = spark.read.schema(df.schema.add("_batch", IntegerType())).option("recursiveFileLookup", "true").parquet(f"{at}/out")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")
    return spark.read.schema(schema or df.schema).parquet(f"{at}/out")


def append_log(df: DataFrame, folder: str) -> None:
    """Append the stream's rows, as they are now, to a log of JSON lines in ``folder``; run again, it adds only what is new."""
    w = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True)
    w.format("json").option("path", f"{folder}/log").option("ignoreNullFields", "false").start().awaitTermination()


def read_until(stream: DataFrame, by: str, order: str, chars: str, cap_tokens: int, folder: str) -> DataFrame:
    """Rows of ``stream`` up to and with the one of each ``by`` that fills the cap of estimated tokens; files are read in turn and reading ends when every key seen has its fill.

    The running totals are a table in ``folder``, one version a batch, so a
    batch that is repeated after a failure starts from the same totals.
    """
    spark = stream.sparkSession
    query = []

    def step(batch: DataFrame, i: int) -> None:
        before = spark.read.parquet(f"{folder}/spent/{i - 1}") if i else spark.createDataFrame([], f"{by} {stream.schema[by].dataType.simpleString()}, _past bigint")
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = batch.join(before, by, "left").withColumn("_past", F.coalesce("_past", F.lit(0)))
        rows.withColumn("_spent", (F.col("_past") + F.coalesce(F.sum(chars).over(w), F.lit(0))) / 4.0).where(F.col("_spent") < cap_tokens).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/out/{i}")
        now = batch.groupBy(by).agg(F.sum(chars).cast("bigint").alias("_past")).unionByName(before).groupBy(by).agg(F.sum("_past").alias("_past"))
        now.write.mode("overwrite").parquet(f"{folder}/spent/{i}")
        if spark.read.parquet(f"{folder}/spent/{i}").where(F.col("_past") / 4.0 < cap_tokens).isEmpty() and query:
            query[0].stop()

    query.append(stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(step).start())
    query[0].awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def latest(df: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """The latest row of each key and how many there were; works on a stream in complete mode and on a table."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(by, "rows", "v.*")


def stalls(df: DataFrame, by: str, order: list[str], step: str, polls: int = POLLS) -> DataFrame:
    """``by`` and ``at``: for each key the first row at which ``step`` hasn't grown for ``polls`` rows in succession."""
    w = Window.partitionBy(by).orderBy(*order)
    grown = F.col(step) > F.lag(step).over(w)
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_g", F.coalesce(grown, F.lit(True)))
    d = d.withColumn("_last", F.max(F.when(F.col("_g"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col("_i") - F.col("_last") >= polls).groupBy(by).agg(F.min("_i").cast("bigint").alias("at"))


def stalls_stream(df: DataFrame, by: str, order: list[str], step: str, polls: int = POLLS) -> DataFrame:
    """The same on a stream, with the state of each key: rows seen, last step, rows without growth.

    Rows of a key must arrive in order across batches; inside a batch they are sorted.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last, still, done = state.get if state.exists else (0, float("-inf"), 0, False)
        out = []
        for x in pd.concat(list(parts)).sort_values(order)[step]:
            seen += 1
            still = 0 if x > last else still + 1
            last = x
            if still >= polls and not done:
                done = True
                out.append(seen)
        state.update((seen, last, still, done))
        yield pd.DataFrame({by: [key[0]] * len(out), "at": out})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, *order, step).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, at bigint", "seen bigint, last double, still bigint, done boolean", "append", "NoTimeout")
