"""Encoding by a vocabulary file of the ``tokenizers`` library, where that is installed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import ship

BATCH = 1000
#: The vocabulary file that the queries use; a parameter everywhere else.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LOADED: dict[str, object] = {}


def _of(path: str):
    try:
        from tokenizers import Tokenizer
    except ImportError as e:  # the rest of the package works without it
        raise RuntimeError("this needs the tokenizers library") from e
    if path not in _LOADED:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids``, without special tokens; null and empty texts give an empty list."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _of(path)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                p = b.slice(at, BATCH)
                ids = [e.ids for e in t.encode_batch([x or "" for x in p.column(1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``key`` and ``text``; a null list gives a null text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x, skip_special_tokens=False) for x in b.column(1).to_pylist()], pa.string())], ["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def _cut(t, text: str, ids: list[int], most: int) -> tuple[str, int]:
    """The text's first ``most`` tokens, back to the last sentence's end where that leaves half of them, and how many they are."""
    if len(ids) <= most:
        return text, len(ids)
    short = t.decode(ids[:most], skip_special_tokens=False)
    whole = _SENTENCE.split(short)
    ended = " ".join(whole[:-1]).strip()
    if len(whole) > 1 and 2 * len(ended) >= len(short):
        short = ended
    short = short.strip()
    return short, len(t.encode(short, add_special_tokens=False).ids)


def truncated(df: DataFrame, key: str, text: str, path: str, most: int) -> DataFrame:
    """``key``, ``text`` cut to at most about ``most`` tokens at a sentence's end where possible, and its ``n_tokens``; null stays null with 0 tokens."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _of(path)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                p = b.slice(at, BATCH)
                texts = p.column(1).to_pylist()
                all_ids = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
                out = [_cut(t, x, e.ids, most) if x is not None else (None, 0) for x, e in zip(texts, all_ids)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["k", "text", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, text string, n_tokens int").withColumnRenamed("k", key)


def examples(df: DataFrame, key: str, prompt: str, completion: str, path: str, most: int) -> DataFrame:
    """``key``, ``ids`` of prompt and completion together and ``boundary``, where the completion begins; both null where they are longer than ``most``.

    Both parts are encoded by themselves, so that the boundary is a token's.
    """
    both = df.select(key, F.coalesce(prompt, F.lit("")).alias("p"), F.coalesce(completion, F.lit("")).alias("c"))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _of(path)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                x = b.slice(at, BATCH)
                p, c = ([e.ids for e in t.encode_batch(x.column(i).to_pylist(), add_special_tokens=False)] for i in (1, 2))
                fits = [len(a) + len(z) <= most for a, z in zip(p, c)]
                ids = [a + z if ok else None for a, z, ok in zip(p, c, fits)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(a) if ok else None for a, ok in zip(p, fits)], pa.int32())], ["k", "ids", "boundary"])

    kind = df.schema[key].dataType.simpleString()
    return both.withColumnRenamed(key, "k").mapInArrow(run, f"k {kind}, ids array<int>, boundary int").withColumnRenamed("k", key)
