"""Problem 4: constraints met, caps kept, copies near the rates."""

import pytest

from corpusmill.llm import mixture
from corpusmill.llm.mixture import Mixture

INDEX = "build_id long, source string, shard int, train_tokens long, written_at timestamp"
CONFIG = "name string, token_budget long, max_repeats int"


def mix(spark, index, config):
    from datetime import datetime

    rows = [(b, s, k, x, datetime(2031, 1, 1, h)) for b, s, k, x, h in index]
    return Mixture(spark.createDataFrame(rows, INDEX).selectExpr("*", "'x' AS name", "1 AS target"), spark.createDataFrame(config, CONFIG).selectExpr("*", "1 AS shard"))


def test_constraints_are_met(spark):
    index = [(1, "case-law", k, 100 * (k + 1), 1) for k in range(20)] + [(1, "Web_Pages", k, 1000, 1) for k in range(5)] + [(1, "tiny", 0, 10, 1)]
    m = mix(spark, index, [("case-law", 40_000, 3), ("web-pages", 2_500, 4), ("tiny", 1000, 6), ("unused", 5, 1)])
    r = {x.source: x for x in m.report().collect()}
    assert set(r) == {"case-law", "web-pages", "tiny"}
    assert r["case-law"].repeats * 21_000 == pytest.approx(40_000, rel=1e-5) and r["web-pages"].repeats == pytest.approx(0.5, rel=1e-5)
    assert r["tiny"].falls_short and r["tiny"].repeats == 6 and not r["case-law"].falls_short
    assert sum(x.real_share for x in r.values()) == pytest.approx(1)
    by = {}
    for c in m.copies().collect():
        assert 0 <= c.copies and c.rate <= 6
        by.setdefault(c.source, []).append(c)
    for cs in by.values():
        assert abs(sum(c.copies for c in cs) - sum(c.rate for c in cs)) < 1
    rates = sorted((c.tokens, c.rate) for c in by["case-law"])
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(rates, rates[1:]))  # tilted by size, within the cap
    assert [tuple(x) for x in m.short().collect()] == [(1, "tiny")]


def test_short_sources_come_from_the_solved_mix_and_unconverged_ones_are_named(spark, monkeypatch):
    index = [(1, "a", k, 100 * (k + 1) ** 2, 1) for k in range(9)] + [(1, "tiny", 0, 10, 1)]
    m = mix(spark, index, [("a", 40_000, 3), ("tiny", 1000, 6)])
    solved, solve = [], m.multipliers
    m.multipliers = lambda: solved.append(1) or solve()
    assert [tuple(x) for x in m.short().collect()] == [(1, "tiny")] and solved
    assert {x.source: x.converged for x in m.report().collect()} == {"a": True, "tiny": None}
    monkeypatch.setattr(mixture, "ITERATIONS", 1)
    assert {x.source: x.converged for x in m.report().collect()} == {"a": False, "tiny": None}


def test_short_sources_change_with_the_dual(spark):
    from pyspark.sql import functions as F

    m = mix(spark, [(1, "a", 0, 100, 1), (1, "tiny", 0, 10, 1)], [("a", 150, 3), ("tiny", 1000, 6)])
    solve = m.multipliers
    m.multipliers = lambda: solve().withColumn("rootless", F.col("source") == "a")
    assert [tuple(x) for x in m.short().collect()] == [(1, "a")]


@pytest.mark.parametrize(("budget", "short"), [(10**11, False), (3 * 5 * 10**10, False), (3 * 5 * 10**10 + 1, True)])
def test_large_token_counts_are_solved(spark, budget, short):
    """Shards of 1e10 tokens; a target that the cap meets to the token is met, one token more isn't."""
    m = mix(spark, [(1, "a", k, 5 * 10**9 * (k + 1), 1) for k in range(4)], [("a", budget, 3)])
    assert [(x.falls_short, x.converged) for x in m.report().collect()] == [(short, None if short else True)]


def test_sums_beyond_64_bits(spark):
    m = mix(spark, [(1, "a", k, 8 * 10**18, 1) for k in range(4)], [("a", 9 * 10**18, 3)])
    r = m.report().collect()[0]
    assert (r.falls_short, r.converged, int(r.train_tokens)) == (False, True, 32 * 10**18) and r.repeats == pytest.approx(9 / 32, rel=1e-5)


def test_rows_that_count(spark):
    index = [(1, " CASE law", 0, 100, 1), (1, "case-law", 0, 40, 2), (1, "case_law", 0, 50, 2), (1, "case-law", 1, None, 3), (1, "case-law", 1, 500, 2), (None, "case-law", 0, 9, 1), (1, None, 0, 9, 1), (2, "case-law", 0, 0, 1)]
    m = mix(spark, index, [("case-law", 200, 4), (None, 1, 1)])
    got = {x.build_id: (x.train_tokens, x.falls_short, x.repeats) for x in m.report().collect()}
    assert got[1][:2] == (50, False) and got[1][2] == pytest.approx(4, rel=1e-5) and got[2] == (0, True, 0)


@pytest.mark.parametrize("config", [[], [("a", None, 1), ("b", 5, None)]])
def test_empty_and_null_settings(spark, config):
    m = mix(spark, [(1, "a", 0, 10, 1), (1, "b", 0, 10, 1)], config)
    got = {x.source: (x.falls_short, x.repeats) for x in m.report().collect()}
    assert got == ({"a": (False, 0), "b": (True, 0)} if config else {})
    assert mix(spark, [], config).short().count() == 0
