"""Problem 7: evaluation items, whole or in pieces, inside corpus documents.

All word windows of the held-out items go into one Aho-Corasick automaton over
normalised text; each document is normalised and scanned once. Documents with
hits are read again with a map of offsets, so each piece found is also reported
where it stands in the original text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.lookalikes import reading
from corpusmill.sources.tables import ship

#: Consecutive words that make a piece; an item with fewer words must stand whole.
WINDOW = 13
#: Items' characters in one automaton, in MB; about 1 GB of memory in each Python worker. A larger set is searched in parts.
ITEMS_MB = 8
_PLAIN = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))
_WORD = re.compile(r"[^\W_]+")
_MARKS = r"[\u0300-\u036f]*"


def words(text: str) -> list[str]:
    """Runs of letters and digits of the text's reading, without letter case."""
    if text.isascii():
        return text.translate(_PLAIN).split()
    return _WORD.findall(reading(text).lower())


def words_at(text: str) -> list[tuple[str, int, int]]:
    """As ``words``, each with its start and end in ``text``."""
    if text.isascii():
        return [(m[0].lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text)]
    chars, at = [], []
    step = re.compile(r".[^\x00-\x7f]*", re.S)
    for m in step.finditer(text):  # an ASCII character with what follows, or a run beyond ASCII
        whole = reading(m[0]).lower()
        parts = [(reading(c[0]).lower(), m.start() + c.start(), m.start() + c.end()) for c in re.finditer("." + _MARKS, m[0], re.S)]
        if "".join(p[0] for p in parts) == whole:
            for p, a, b in parts:
                chars += p
                at += [(a, b)] * len(p)
        else:
            chars += whole
            at += [m.span()] * len(whole)
    return [(m[0], at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer("".join(chars))]


def patterns(items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[str, set[int]]:
    """The pieces to look for and whose they are."""
    out: dict[str, set[int]] = {}
    for item, text in items:
        w = words(text or "")
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(" " + " ".join(w[k : k + window]) + " ", set()).add(item)
    return out


_BUILT: dict[int, tuple] = {}


def automaton(items: list[tuple[int, str | None]], window: int):
    """The automaton of the items, and the sorted items of each of its patterns; kept in the worker."""
    import ahocorasick

    key = hash((window, tuple(items)))
    if key not in _BUILT:
        _BUILT.clear()
        a, whose = ahocorasick.Automaton(), []
        for p, ids in patterns(items, window).items():
            a.add_word(p, len(whose))
            whose.append(sorted(ids))
        if whose:
            a.make_automaton()
        _BUILT[key] = a, whose
    return _BUILT[key]


def found(df: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, window: int = WINDOW, spans: bool = False, items_mb: float = ITEMS_MB) -> DataFrame:
    """``key`` and ``item_id`` of each row and each item it holds a piece of.

    With ``spans``, also ``start_at`` and ``end_at`` in the original text (the
    end excluded) and ``words`` of each maximal piece. Items without a word and
    rows whose text is null, empty or blank match nothing; equal items are all
    reported; repeated rows count once. An empty table on either side gives an
    empty result. The items are the held-out set, which is small by nature: one
    automaton holds up to ``items_mb`` of them. A larger set is dealt to parts
    of about that size by hash, and the corpus is scanned once for each part.
    The corpus isn't shuffled; only hits are made distinct.
    """
    ship(df.sparkSession)
    held = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = held.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / (items_mb * 1e6)))
    held = held.distinct()
    src = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"__key {kind}, item_id bigint" + (", start_at int, end_at int, words int" if spans else "")
    out = None
    for k in range(parts):
        part = held.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        hits = src.mapInArrow(_scanner(sorted((r.i, r.t) for r in part.collect()), window, spans), schema)
        out = hits if out is None else out.unionByName(hits)
    return out.distinct().withColumnRenamed("__key", key)


def _scanner(rows: list[tuple[int, str]], window: int, spans: bool):
    """The scan of Arrow batches of keys and texts for the items ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, whose = automaton(rows, window)
        for b in batches:
            hits = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if whose else ():
                if not t:
                    continue
                ids = {i for _, p in a.iter(" " + " ".join(words(t)) + " ") for i in whose[p]}
                hits += pieces(k, t, ids) if spans and ids else [(k, i) for i in ids]
            cols = list(zip(*hits)) or [()] * (5 if spans else 2)
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["__key", "item_id", "start_at", "end_at", "words"][: len(cols)])

    def pieces(k, t: str, ids: set[int]) -> list[tuple]:
        out, a, whose = [], *automaton(rows, window)
        at = words_at(t)
        starts, line = {}, " "
        for n, (w, _, _) in enumerate(at):
            starts[len(line)] = n
            line += w + " "
        ends = {p + len(at[n][0]): n for p, n in starts.items()}
        runs: dict[int, list[list[int]]] = {}
        for end, p in a.iter(line):
            last = ends[end]
            for i in whose[p]:
                n = min(window, lengths[i])
                have = runs.setdefault(i, [])
                if have and have[-1][1] >= last - 1 and lengths[i] >= window:
                    have[-1][1] = last
                else:
                    have.append([last - n + 1, last])
        for i, have in runs.items():
            out += [(k, i, at[x][1], at[y][2], y - x + 1) for x, y in have]
        return out

    lengths = {i: len(words(t)) for i, t in rows}
    return run
