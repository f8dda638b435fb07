"""Queries of file sources and sinks: each writes to the shared folder and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dedup
from corpusmill.plans import cleaning, curation, packing
from corpusmill.plans import dedup as dups
from corpusmill.plans.registry import SQL, query
from corpusmill.sources import files
from corpusmill.sources.tables import scratch, table
from corpusmill.streaming import metrics

_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'))"


def _written(spark: SparkSession, d: str) -> str:
    folder = scratch(spark, "lines")
    files.write_lines(table(spark, d, "documents").select("source", "text"), folder)
    return folder


@query(f"SELECT source, sum(octet_length(encode({_FLAT})) + 1)::BIGINT AS bytes FROM documents GROUP BY source")
def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files found by a pattern and their sizes, by the source in their path; contents are not read."""
    found = files.shards(spark, f"{_written(spark, d)}/source=*/*.txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("bytes").alias("bytes"))


@query(rf"WITH l AS (SELECT source, {_FLAT} AS t FROM documents) SELECT source, count(*) AS docs, sum(length(t))::BIGINT AS chars, count(DISTINCT t) AS texts FROM l WHERE t <> '' GROUP BY source")
def written_lines(spark: SparkSession, d: str) -> DataFrame:
    """One document a line, written and read again with line numbers; no number occurs twice in a file."""
    back = files.read_lines(spark, f"{_written(spark, d)}/source=*/*.txt", keep="path")
    once = back.groupBy("file", "line_no").agg(F.first("text").alias("text"))
    return once.groupBy(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.count_distinct("text").alias("texts"))


_FIELDS = ("id", "source", "question", "answer", "context_tokens", "drop_reason")


@query("SELECT id, source, context_tokens, drop_reason, md5(concat_ws('|', coalesce(question, '~'), coalesce(answer, '~'))) AS hash FROM candidate")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as JSON lines, written and read again by a given schema; nulls stay nulls."""
    folder, c = scratch(spark, "jsonl"), table(spark, d, "candidate").select(*_FIELDS)
    files.write_jsonl(c, folder)
    back = files.read_jsonl(spark, folder, c.schema)
    hash_ = F.md5(F.concat_ws("|", F.coalesce("question", F.lit("~")), F.coalesce("answer", F.lit("~"))))
    return back.select("id", "source", "context_tokens", "drop_reason", hash_.alias("hash"))


@query(SQL["drop_report"])
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The drop report as a JSON file, read again."""
    folder, r = scratch(spark, "report"), cleaning.drop_report(spark, d)
    files.write_report(r, folder)
    return files.read_jsonl(spark, folder, r.schema)


@query(f"WITH {packing._PACK}, s AS (SELECT source, window_id, CASE WHEN window_id % 100 = 0 THEN 'val' ELSE 'train' END AS split, md5(array_to_string(tokens, ' ')) AS hash FROM wn) SELECT source, split, row_number() OVER (PARTITION BY source, split ORDER BY window_id) - 1 AS at, hash FROM s")
def window_files(spark: SparkSession, d: str) -> DataFrame:
    """Token windows as files of two-byte ids by split, read again."""
    folder = scratch(spark, "windows")
    files.write_windows(packing._windows(spark, d).withColumn("shard", F.lit(0)), folder)
    back = files.read_windows(spark, folder, keep="path")
    name = lambda p, k: F.regexp_extract("path", p, k)
    return back.select(name(r"/([^/]+)-0-\d+\.bin$", 1).alias("source"), name(r"/(train|val)/[^/]+$", 1).alias("split"), F.col("window_id").alias("at"), F.md5(F.array_join("tokens", " ")).alias("hash"))


@query(f"WITH {packing._PACK.split('wn AS')[0].rstrip().rstrip(',')}, n AS (SELECT source, count(*) AS n FROM tk GROUP BY source), w AS (SELECT source, unnest(range(0, greatest(0, (n - 1) // 1024))) AS win FROM n), o AS (SELECT source, win, row_number() OVER (ORDER BY source, win) - 1 AS i FROM w) SELECT source, win, i FROM o WHERE i % 8 = 3")
def strided_reader(spark: SparkSession, d: str) -> DataFrame:
    """An older reader's windows: of each file all but the last token in whole windows, files in order of names, every eighth from the fourth."""
    from corpusmill.operators.order import ranked

    n = table(spark, d, "documents").groupBy("source").agg(F.sum(F.size(T.words(T.text_of(F.col("text")))) + 1).alias("n"))
    w = n.withColumn("k", F.floor((F.col("n") - 1) / packing.pack.SEQ)).where("k > 0").select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("win"))
    return ranked(w, [], ["source", "win"], "i").where("i % 8 = 3")


@query(SQL["pad_and_mask"])
def example_table(spark: SparkSession, d: str) -> DataFrame:
    """Padded examples written as a table, checked on both ways."""
    folder = scratch(spark, "examples")
    files.write_examples(curation.pad_and_mask(spark, d), folder, 48, 1 << 14)
    return files.read_examples(spark, folder, 48, 1 << 14)


@query(SQL["contamination_grams"])
def gram_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Held-out grams as an artifact with the fingerprint of their rule; another rule's would be refused."""
    folder = scratch(spark, "grams")
    files.save_artifact(dups._held(spark, d), folder, "words-13")
    return files.load_artifact(spark, folder, "words-13")


@query(f"SELECT DISTINCT unnest({dups._grams(13)}) AS gram FROM (SELECT {dups._W} AS w FROM benchmark UNION ALL SELECT {dups._W.replace('text', 'question')} FROM candidate)")
def gram_union(spark: SparkSession, d: str) -> DataFrame:
    """The distinct grams of several held-out sets."""
    sets = [table(spark, d, "benchmark").select("text"), table(spark, d, "candidate").select(F.col("question").alias("text"))]
    return dedup.gram_set(sets[0].unionByName(sets[1]), "text")


@query("SELECT 'documents.parquet' AS file, count(*) AS rows, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents UNION ALL SELECT 'passage.parquet', count(*), sum(length(coalesce(text, '')))::BIGINT FROM passage")
def many_files(spark: SparkSession, d: str) -> DataFrame:
    """One column of several files as one table."""
    return files.read_texts(spark, [f"{d}/documents.parquet", f"{d}/passage.parquet"], "text").groupBy("file").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, user_id, round(value, 9) AS value FROM events")
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows appended to a log of JSON lines by a stream; a second run appends nothing twice."""
    folder, e = scratch(spark, "log"), table(spark, d, "events")
    for _ in range(2):
        metrics.append_log(metrics.stream(spark, d, "events", e.schema).select("event_id", "user_id", "value"), folder)
    return spark.read.schema(e.select("event_id", "user_id", "value").schema).json(f"{folder}/log").withColumn("value", F.round("value", 9))


@query(SQL["budget_cutoff"])
def budget_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each shard read as a stream of files up to the record that fills its budget, with running totals."""
    folder = scratch(spark, "budget")
    once = table(spark, d, "clean_result").where("kept").groupBy("rec_id").agg(F.min_by(F.struct("shard", "line_no", F.coalesce("clean_chars", F.lit(0)).alias("n")), "ingested_at").alias("r")).select("r.*")
    parts = F.floor(F.col("line_no") / 100)  # pieces of each shard that arrive one after the other
    pieces = once.withColumn("piece", F.least(parts, F.lit(2))).cache()
    for k in range(3):
        pieces.where(F.col("piece") == k).drop("piece").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    pieces.unpersist()
    s = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return metrics.read_until(s, "shard", "line_no", "n", 10_000, folder).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
