"""Problem 1: every item placed once, nothing split, few windows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import packing

SCHEMA = "rec_table string, rec_id string, tokens int"


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_places_each_item_once(case):
    capacity, items = case
    placed = Counter()
    for content, n in packing.plan(Counter(items), capacity):
        assert n > 0 and sum(content) <= capacity
        assert sum(3 * x > capacity for x in content) <= 2
        for x in content:
            placed[x] += n
    assert placed == Counter(items)


def test_plan_is_near_the_bound():
    r = random.Random(1)
    counts = Counter(min(1024, max(20, int(r.gauss(320, 180)))) for _ in range(20_000))
    windows = sum(n for _, n in packing.plan(counts, 1024))
    assert windows <= math.ceil(sum(k * n for k, n in counts.items()) / 1024) * 1.01


def test_items_end_in_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)  # many salted parts
    rows = [("a", f"i{k}", 300) for k in range(40)] + [("b", f"i{k}", 100 + k) for k in range(20)]
    rows += [("a", "long", 2500), ("a", "whole", 2048), ("a", "i0", 300), ("a", "none", None), ("a", "zero", 0), ("a", "minus", -5), ("a", None, 10)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS window_id", "1 AS piece", "2 AS length")  # clashing names
    got = packing.Packed(df).assigned().collect()
    used, seen = defaultdict(int), Counter()
    for r in got:
        used[r.window_id] += r.length
        seen[r.rec_table, r.rec_id] += r.length
    assert max(used.values()) <= 1024
    assert seen == Counter({(t, i): n for t, i, n in rows if i and n and n > 0})
    assert sorted((r.rec_id, r.length) for r in got if r.tokens > 1024) == [("long", 452), ("long", 1024), ("long", 1024), ("whole", 1024), ("whole", 1024)]
    w = packing.Packed(df).windows().collect()
    assert all(x.used + x.unused == 1024 for x in w) and len(w) == len(used)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.Packed(empty).assigned().count() == 0 and packing.Packed(empty).windows().count() == 0


@pytest.mark.parametrize("partitions", [1, 16])
def test_partitioning_changes_nothing(spark, partitions):
    df = spark.createDataFrame([("a", f"i{k}", 50 + k % 400) for k in range(200)], SCHEMA)
    want = {(r.rec_id, r.window_id) for r in packing.Packed(df).assigned().collect()}
    assert {(r.rec_id, r.window_id) for r in packing.Packed(df.repartition(partitions)).assigned().collect()} == want
