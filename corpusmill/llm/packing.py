"""Problem 1: items of varying length into windows of fixed capacity.

Large-item matching: items above a third of the capacity go at most two to a
window, matched greedily, the largest with the largest that still fits; smaller
items then fill the remaining gaps by best fit, the largest first. Items of one
length are interchangeable, so the plan is made on the histogram of lengths,
which has at most ``capacity`` entries however many items there are, and comes
out as groups of windows with the same content. Items find their place by their
rank among the items of their length, counted in salted parts.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut, ship

CAPACITY = 1024
#: Items in one part of the ranking, on average; also bounds the part of a length that a third of all items have.
PART = 1 << 18


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of windows and how many windows have them; every item of ``counts`` (number by length) is in one."""
    left = {n: c for n, c in counts.items() if c and 0 < n <= capacity}
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [content, number]

    def put(content: tuple[int, ...], number: int) -> None:
        if number:
            open_[capacity - sum(content)].append([content, number])

    # matching: at most two items above a third
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        have = left[n]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            put((n,), have)
            del large[-1]
            continue
        m = large[at]
        if m == n:
            put((n, n), have // 2)
            if have % 2 == 0:
                del large[-1]
            else:  # the odd one goes with the next smaller, if any
                left[n] = 1
                if at == 0:
                    put((n,), 1)
                    del large[-1]
                else:
                    put((n, large[at - 1]), 1)
                    left[large[at - 1]] -= 1
                    if not left[large[at - 1]]:
                        del large[at - 1]
                    large.pop()
            continue
        k = min(have, left[m])
        put((n, m), k)
        left[n] -= k
        left[m] -= k
        for x in (n, m):
            if not left[x]:
                large.remove(x)
    # best fit of the smaller items, largest first
    gaps = sorted(g for g in open_ if open_[g])
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        have = left[n]
        while have:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):  # no window has room: as many new ones as the items need
                each = capacity // n
                full, rest = divmod(have, each)
                put((n,) * each, full)
                if rest:
                    put((n,) * rest, 1)
                gaps = sorted(g for g in open_ if open_[g])
                break
            gap = gaps[at]
            content, number = open_[gap].pop()
            k = min(number, have)
            if k < number:
                open_[gap].append([content, number - k])
            elif not open_[gap]:
                del gaps[at]
            new = gap - n
            if not open_[new]:
                bisect.insort(gaps, new)
            open_[new].append([(*content, n), k])
            have -= k
    return [(content, number) for g in sorted(open_) for content, number in open_[g]]


class Packed:
    """Every item of ``items`` (rec_table, rec_id, tokens) in its window.

    Repeated items count once, with their greatest length; rows with a null id,
    or a null, zero or negative length, take no part. Items longer than the
    capacity are cut into full windows and a rest, no other is split. An empty
    table gives empty results. Ties (equal lengths) are placed by hash and id.
    """

    def __init__(self, items: DataFrame, capacity: int = CAPACITY):
        ship(items.sparkSession)
        self.capacity = capacity
        once = items.where("rec_id IS NOT NULL AND tokens > 0").groupBy("rec_table", "rec_id").agg(F.max("tokens").cast("bigint").alias("tokens"))
        self.items = cut(once)

    def pieces(self) -> DataFrame:
        c = F.lit(self.capacity)
        n = F.ceil(F.col("tokens") / c).cast("int")
        length = F.when(F.col("piece") < n - 1, c).otherwise(F.col("tokens") - (n - 1) * c).cast("int")
        return self.items.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("length", length)

    def assigned(self) -> DataFrame:
        """rec_table, rec_id, tokens, piece, length, window_id."""
        pieces = self.pieces()
        counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
        slots, base = defaultdict(list), 0
        for content, number in plan(counts, self.capacity):
            for n, times in Counter(content).items():
                slots[n].append((base, times, number))
            base += number
        table = {}
        for n, of in slots.items():
            bases, times, numbers = (np.array(x, dtype=np.int64) for x in zip(*of))
            table[n] = np.concatenate([[0], np.cumsum(times * numbers)]), bases, times
        parts = max(1, sum(counts.values()) // PART)
        salted = pieces.withColumn("part", F.pmod(F.xxhash64("rec_table", "rec_id", "piece"), F.lit(parts)).cast("int"))
        sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        within = Window.partitionBy("length", "part").orderBy(F.xxhash64("rec_id", "rec_table"), "rec_table", "rec_id", "piece")
        ranked = salted.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("offset"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                length, rank = b.column(4).to_numpy(), b.column(5).to_numpy()
                out = np.empty(len(rank), np.int64)
                for n in np.unique(length):
                    at = np.flatnonzero(length == n)
                    starts, bases, times = table[int(n)]
                    k = np.searchsorted(starts, rank[at], "right") - 1
                    out[at] = bases[k] + (rank[at] - starts[k]) // times[k]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out)], ["rec_table", "rec_id", "tokens", "piece", "length", "window_id"])

        return ranked.select("rec_table", "rec_id", "tokens", "piece", "length", F.col("rank").cast("bigint")).mapInArrow(place, "rec_table string, rec_id string, tokens bigint, piece int, length int, window_id bigint")

    def windows(self) -> DataFrame:
        """window_id, items, used, unused."""
        return self.assigned().groupBy("window_id").agg(F.count("*").alias("items"), F.sum("length").cast("int").alias("used")).withColumn("unused", (F.lit(self.capacity) - F.col("used")).cast("int"))
