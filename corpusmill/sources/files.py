"""Readers and writers of corpus files beyond plain tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.sources.tables import ship

SEQ = 1024
#: Windows in one file of two-byte ids: 32 MB.
WINDOWS = 1 << 14


def read_texts(spark: SparkSession, paths: str | list[str], field: str) -> DataFrame:
    """One text column of Parquet files; null and missing texts become empty, other types strings."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("text"), F.col("_metadata.file_name").alias("file"))


def shards(spark: SparkSession, pattern: str) -> DataFrame:
    """name, path, bytes of the files that fit ``pattern``; contents are not read."""
    f = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "bytes").orderBy("name")


def read_lines(spark: SparkSession, pattern: str, keep: str = "name") -> DataFrame:
    """file (its name, or with ``keep="path"`` its path), line_no (from 0; blank lines count), text of the lines that aren't blank.

    A file is read in blocks by many tasks. Each block's lines are numbered by
    themselves and moved on by the lines of the blocks before it, so no file is
    one task's work and no order of partitions is relied on.
    """
    raw = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    here = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    rows = raw.withColumn("here", here).join(blocks, ["file", "block"])
    name = F.col("file") if keep == "path" else F.element_at(F.split("file", "/"), -1)
    return rows.select(name.alias("file"), (F.col("past") + F.col("here")).alias("line_no"), F.col("value").alias("text")).where(F.trim("text") != "")


def pick_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` at the (file, line_no) of ``wanted``."""
    return lines.join(wanted.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi")


def write_lines(df: DataFrame, folder: str, text: str = "text", source: str = "source") -> None:
    """One document a line, in a folder for each source; line breaks become blanks."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\r\n]+", " "))
    df.select(F.col(source).alias("source"), flat.alias("value")).write.mode("overwrite").partitionBy("source").text(folder)


def read_jsonl(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines by a given schema: unknown keys are dropped, blank lines skipped; lines that are no JSON are left out."""
    kept = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(pattern).where(F.trim("value") != "")
    return raw.select(F.from_json("value", kept).alias("r")).where("r IS NOT NULL").select("r.*").where(F.greatest(*[F.col(f"`{c}`").isNotNull().cast("int") for c in kept.names], F.lit(0)) > 0)


def write_jsonl(df: DataFrame, folder: str) -> None:
    """JSON lines in UTF-8; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def local_path(folder: str) -> str:
    """The folder as a path of the file system that the executors share."""
    return folder.removeprefix("file://").removeprefix("file:")


def write_windows(df: DataFrame, folder: str, limit: int = 1 << 16, per_file: int = WINDOWS) -> int:
    """Windows (source, shard, window_id, split, tokens) as files of two-byte ids, ``split/source-shard-part.bin``; the number of ids.

    The folder must be one that all executors share. Ids beyond two bytes are an
    error. A file holds the windows of a stretch of ``per_file`` ids, so a shard
    of any size is many tasks' work; in order of names they follow each other.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)  # there even without a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = None, None, 0
        for b in batches:
            for source, shard, part, split, tokens in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), b.column(5)):
                ids = tokens.values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= limit):
                    raise ValueError(f"an id outside 0..{limit - 1}")
                if (source, shard, part, split) != name:
                    if out:
                        out.close()
                    name = (source, shard, part, split)
                    os.makedirs(f"{folder}/{split}", exist_ok=True)
                    out = open(f"{folder}/{split}/{source}-{shard}-{part:06d}.bin", "wb")  # noqa: SIM115
                out.write(ids.astype("<u2").tobytes())
                n += len(ids)
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship(df.sparkSession)
    part = F.floor(F.col("window_id") / per_file).cast("int").alias("part")
    rows = df.select(F.col("source").cast("string"), F.col("shard").cast("string"), part, "window_id", "split", "tokens").repartition("source", "shard", "part", "split").sortWithinPartitions("source", "shard", "part", "split", "window_id")
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_windows(spark: SparkSession, pattern: str, length: int = SEQ, keep: str = "name") -> DataFrame:
    """name (with ``keep="path"``, path), window_id in the file, tokens of the files of two-byte ids that fit ``pattern``, or of all ``.bin`` files below it; a last piece shorter than a window is dropped."""
    ship(spark)
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin")
    if "*" not in pattern:
        source = source.option("recursiveFileLookup", "true")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(content, dtype="<u2")
                n = len(ids) // length
                flat = pa.array(ids[: n * length].astype(np.int32))
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), flat)
                yield pa.RecordBatch.from_arrays([pa.array([path if keep == "path" else path.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(np.arange(n)), tokens], [keep, "window_id", "tokens"])

    return source.load(pattern).select("path", "content").mapInArrow(run, f"{keep} string, window_id bigint, tokens array<int>")


def check_examples(df: DataFrame, width: int, vocabulary: int) -> None:
    """Raise unless tokens, loss_mask and attn_mask are of one ``width`` and every id is in the vocabulary."""
    bad = df.agg(
        F.count_if((F.size("tokens") != width) | (F.size("loss_mask") != width) | (F.size("attn_mask") != width)).alias("shape"),
        F.count_if((F.array_max("tokens") >= vocabulary) | (F.array_min("tokens") < 0)).alias("ids"),
    ).first()
    if bad["shape"] or bad["ids"]:
        raise ValueError(f"{bad['shape']} rows of another width, {bad['ids']} with ids outside the vocabulary")


def write_examples(df: DataFrame, folder: str, width: int, vocabulary: int) -> None:
    """tokens, loss_mask and attn_mask of each example (with its other columns) as one table; wrong widths and ids are refused before anything is written."""
    check_examples(df, width, vocabulary)
    df.write.mode("overwrite").parquet(folder)


def read_examples(spark: SparkSession, folder: str, width: int, vocabulary: int) -> DataFrame:
    """The table of ``write_examples``, checked again."""
    df = spark.read.parquet(folder)
    check_examples(df, width, vocabulary)
    return df


def write_report(df: DataFrame, folder: str) -> None:
    """A report, which is small, as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def save_artifact(df: DataFrame, path: str, fingerprint: str) -> None:
    """A derived table with the fingerprint of how it was made."""
    df.withColumn("_made_by", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """The table, if it was made as ``fingerprint`` says; an empty one or another maker is an error."""
    df = spark.read.parquet(path)
    made = [r[0] for r in df.select("_made_by").distinct().limit(2).collect()]
    if made != [fingerprint]:
        raise ValueError(f"{path} was made by {made or 'nothing'}, not by {fingerprint}")
    return df.drop("_made_by")
