"""Places in an order, and the selection of pairs against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import curate
from corpusmill.operators.order import ranked


def test_places_are_those_of_a_sort(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), r.randrange(9), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    got = {(x.g, x.place): (x.x, x.id) for x in ranked(df, ["g"], [F.desc("x"), "id"]).collect()}
    for g in ("a", "b", None):
        want = sorted(((x, i) for k, x, i in rows if k == g), key=lambda t: (-t[0], t[1]))
        assert [got[g, n] for n in range(len(want))] == want
    everything = {x.place: x.id for x in ranked(df, [], ["id"]).collect()}
    assert everything == {k: k for k in range(500)}
    assert ranked(df.where("false"), ["g"], ["id"]).count() == 0


def test_a_group_of_most_rows_is_several_ranges(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df, ["g"], ["id"])
        assert out.where("place != id").isEmpty() and out.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def pairs(spark, n=220, seed=4):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    base = rng.normal(size=(25, 8))
    rows = []
    for k in range(n):
        v = base[r.randrange(25)] + rng.normal(size=8) * r.choice([0.0, 0.05, 0.6])
        q = f"What was {r.choice('abcdefghij')} in {r.randrange(30)}?"
        a = r.choice(["long answer " * 20, "another long answer " * 15, f"short {k}"])
        rows.append((f"id{k:03d}", r.choice(["case-law", "case-law", "sec", "fineweb-edu"]), r.choice(["lookup", "lookup", "reasoning", "unanswerable", None]), q, a, r.choice(["keep", "keep", "keep", "drop", None]), r.choice([4, 5, None]), None if k % 40 == 7 else [float(x) for x in v]))
    return rows


def sequential(rows, near, held, evals, most):
    """The rule as one pass after the other, in the order of hashes that the operator uses."""
    import hashlib

    md5 = lambda s, i: hashlib.md5(f"{s}:{i}".encode()).hexdigest()
    fate, seen, once, unit = {}, set(), [], {}
    for i, s, t, q, a, v, score, vec in sorted(rows):
        if v != "keep":
            fate[i] = "judge_fail"
        elif q in seen:
            fate[i] = "exact_dup"
        else:
            seen.add(q)
            once.append((i, s, t, q, a, score or 0, vec))
        unit[i] = None if vec is None else np.array(vec) / np.linalg.norm(vec)
    long, fresh = set(), []
    for x in once:
        if len(x[4]) > 200 and x[4] in long:
            fate[x[0]] = "boilerplate_answer"
            continue
        long |= {x[4]} if len(x[4]) > 200 else set()
        fresh.append(x)
    kept = []
    for x in sorted(fresh, key=lambda x: (-x[5], md5("11", x[0]), x[0])):
        u = unit[x[0]]
        if u is not None and any(unit[y[0]] is not None and round(float(u @ unit[y[0]]), 6) >= near for y in kept):
            fate[x[0]] = "near_dup"
        else:
            kept.append(x)
    pool = {s: sorted((x for x in kept if x[1] == s), key=lambda x: (md5("11", x[0]), x[0])) for s in curate.SOURCE_MIX}

    def allocate(total, mix):
        out = {k: int(total * v) for k, v in mix.items()}
        for k in sorted(mix, key=lambda k: -(total * mix[k] - int(total * mix[k]))):
            if sum(out.values()) < total:
                out[k] += 1
        return out

    total = min(most + evals, *(int(len(p) / curate.SOURCE_MIX[s]) for s, p in pool.items() if p))
    chosen = []
    for s, want in allocate(total, curate.SOURCE_MIX).items():
        picked = [x for t, n in allocate(want, curate.TYPE_MIX).items() for x in [y for y in pool[s] if y[2] == t][:n]]
        picked += [x for x in pool[s] if x not in picked][: max(0, want - len(picked))]
        chosen += picked[:want]
    fate |= {x[0]: "stratify_drop" for x in kept if x not in chosen}
    chosen.sort(key=lambda x: (md5("11:eval", x[0]), x[0]))
    for n, x in enumerate(chosen):
        u = unit[x[0]]
        close = u is not None and any(unit[y[0]] is not None and round(float(u @ unit[y[0]]), 6) >= held for y in chosen[:evals])
        fate[x[0]] = "eval" if n < evals else "eval_contaminated" if close else "kept"
    return fate


@pytest.mark.parametrize("seed", [4, 9])
def test_selection_is_the_sequential_rule(spark, seed):
    rows = pairs(spark, seed=seed)
    df = spark.createDataFrame(rows, "id string, source string, type string, question string, answer string, verdict string, score int, vector array<double>").selectExpr("*", "1 AS place", "2 AS quota", "'x' AS h")
    got = dict(curate.select_pairs(df, near=0.95, held=0.6, evals=6, most=60).select("id", "fate").collect())
    assert got == sequential(rows, 0.95, 0.6, 6, 60)
    assert {"exact_dup", "near_dup", "stratify_drop", "eval", "kept", "eval_contaminated"} <= set(got.values())


def test_selection_of_nothing(spark):
    schema = "id string, source string, type string, question string, answer string, verdict string, score int, vector array<double>"
    assert curate.select_pairs(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([("a", "sec", None, None, None, "keep", None, None), ("b", "other", "lookup", "q", "a", None, 5, [1.0])], schema)
    assert dict(curate.select_pairs(one).select("id", "fate").collect()) == {"a": "eval", "b": "judge_fail"}
