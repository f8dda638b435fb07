"""Problem 5: against brute force."""

import random
import re

import numpy as np

from corpusmill.llm import neardup

SCHEMA = "rec_id long, text string, at timestamp"


def brute(texts, least=0.5):
    sets = {}
    for i, t in texts:
        if t and t.strip():
            w = re.findall("[a-z0-9]+", t.lower())
            sets[i] = t, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a][0] == sets[b][0] or (sets[a][1] | sets[b][1] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= least)}


def corpus(seed=4, n=250):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    base = [[r.choice(words) for _ in range(r.randint(60, 160))] for _ in range(40)]
    out = []
    for k in range(n):
        t = list(r.choice(base)) if r.random() < 0.6 else [r.choice(words) for _ in range(90)]
        for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
            at = r.randrange(len(t))
            t[at : at + r.randint(0, 1)] = [f"x{r.randrange(10**6)}"]
        out.append((k, " ".join(t).capitalize() if r.random() < 0.3 else " ".join(t)))
    return out


def test_pairs_match_brute_force(spark):
    texts = corpus() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "two words"), (1005, "Two words"), (1006, "long " * 20_000)]
    want = brute(texts)
    df = spark.createDataFrame([(i, t, None) for i, t in texts] + [(None, texts[0][1], None)], SCHEMA).selectExpr("*", "1 AS k", "2 AS c", "'x' AS t")
    got = [(r.rec_a, r.rec_b) for r in neardup.NearDuplicates(df, "rec_id", "text", "at").pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got) & want) >= 0.995 * len(want)
    assert (1003, 1004) in got and (1003, 1005) not in got


def test_pairs_of_a_family_of_a_third_of_the_rows(spark):
    r = random.Random(7)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(f"v{r.randrange(10**6)}" for _ in range(100))) for k in range(200)]
    for k in range(200, 300):  # each its own words in a few places: what they share is frequent, what differs is rare
        t = list(base)
        for at in r.sample(range(100), r.choice([3, 4])):
            t[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    want = brute(rows)
    got = {(x.rec_a, x.rec_b) for x in neardup.NearDuplicates(spark.createDataFrame([(*x, None) for x in rows], SCHEMA), "rec_id", "text").pairs().collect()}
    assert len(want) > 1000 and got <= want and len(got) >= 0.99 * len(want)


def test_latest_delivery_counts(spark):
    from datetime import datetime

    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(1, a, datetime(2031, 1, 1)), (1, a, datetime(2031, 1, 2)), (2, a, datetime(2031, 1, 1)), (2, b, datetime(2031, 1, 5)), (3, b, None)]
    got = {(r.rec_a, r.rec_b) for r in neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA), "rec_id", "text", "at").pairs().collect()}
    assert got == {(2, 3)}


def test_large_classes_are_stars_with_full_membership(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ALL_PAIRS", 10)
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(k, a, None) for k in range(30)] + [(100, a + " end", None)]
    n = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA), "rec_id", "text")
    got = {(r.rec_a, r.rec_b) for r in n.pairs().collect()}
    assert got == {(0, k) for k in range(1, 30)} | {(k, 100) for k in range(30)}
    g = {r.rec_id: (r.class_id, r.group_id, r.links) for r in n.groups().collect()}
    assert set(g) == {*range(30), 100} and {x[1] for x in g.values()} == {0} and g[100] == (100, 0, 1) and {g[k][0] for k in range(30)} == {0}


def test_links_of_large_classes_keep_every_row(spark, monkeypatch):
    """Of two linked texts with 30 and 20 copies each row is paired with the other's first; with the classes that gives all pairs again."""
    monkeypatch.setattr(neardup, "ALL_PAIRS", 10)
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(k, a, None) for k in range(30)] + [(100 + k, a + " end", None) for k in range(20)] + [(200, a + " other end", None)]
    n = neardup.NearDuplicates(spark.createDataFrame(rows, SCHEMA), "rec_id", "text")
    got = [(r.rec_a, r.rec_b) for r in n.pairs().collect()]
    assert len(got) == len(set(got)) and {(k, 100) for k in range(30)} | {(0, 100 + k) for k in range(20)} <= set(got)
    assert {(k, 200) for k in range(30)} | {(100 + k, 200) for k in range(20)} <= set(got)
    of = {r.rec_id: r.class_id for r in n.groups().collect()}
    linked = {(of[x], of[y]) for x, y in got}
    assert {(x, y) for x in of for y in of if x < y and (of[x] == of[y] or (of[x], of[y]) in linked)} == brute([r[:2] for r in rows])


def test_a_text_of_a_third_of_the_rows_is_one_row_in_the_bands_and_has_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 16, raising=False)
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(k, a) for k in range(150)] + [(200 + k, f"{a} end{k % 3}") for k in range(130)] + [(400 + k, " ".join(f"c{k}x{i}" for i in range(60))) for k in range(170)]
    n = neardup.NearDuplicates(spark.createDataFrame([(*x, None) for x in rows], SCHEMA), "rec_id", "text")
    got = [(r.rec_a, r.rec_b) for r in n.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)

    seen = []
    join = type(n.df).join
    monkeypatch.setattr(type(n.df), "join", lambda self, other, *on: seen.append(self.count()) or join(self, other, *on))
    n.candidates()
    assert seen == [len(neardup.BANDS) * (1 + 3 + 170)]


def test_groups_are_components(spark):
    r = random.Random(2)
    edges = [tuple(r.sample(range(60), 2)) for _ in range(35)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.c: x.root for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e}


def test_empty_table(spark):
    n = neardup.NearDuplicates(spark.createDataFrame([], SCHEMA), "rec_id", "text", "at")
    assert n.pairs().count() == 0 and n.groups().count() == 0


def test_samples_agree_by_the_weighted_and_by_the_plain_similarity():
    """Texts that share shingles frequent in the corpus and differ in rare ones, and the other way round."""
    r = random.Random(5)
    some = lambda n: " ".join(f"y{r.randrange(10**9)}" for _ in range(n))
    for shared, own in ((0.8, 8.0), (8.0, 0.8)):
        agree, weighted, plain = [], [], []
        for _ in range(1500):
            same = some(45)
            row, h, n = neardup.shingles([f"{same} {some(30)}", f"{same} {some(15)} {' '.join(same.split()[:9])}"])
            w = (np.where(np.isin(h, neardup.shingles([same])[1]), shared, own) * n).astype(np.float32)
            x, y = (dict(zip(h[row == i].tolist(), w[row == i].tolist())) for i in (0, 1))
            weighted.append(sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}))
            plain.append(len({*x} & {*y}) / len({*x, *y}))
            s = neardup.samples(row, h, w)[1]
            agree.append(s[0] == s[1])
        got = np.mean(agree, 0)
        assert abs(got[: neardup.WEIGHTED].mean() - np.mean(weighted)) < 0.02 and abs(got[neardup.WEIGHTED :].mean() - np.mean(plain)) < 0.02
        assert abs(np.mean(weighted) - np.mean(plain)) > 0.2


def test_weights_come_from_all_records(spark):
    t = [" ".join(f"{x}{k}" for k in range(20)) for x in "abc"]
    freq = neardup.frequencies(spark.createDataFrame([(x,) for x in [t[0]] * 90 + t + [None, "", "two words"]], "t string"), "t")
    idf, (row, h, _) = neardup.weights(freq), neardup.shingles(t)
    assert freq[-1] == 93 and freq[:-1].sum() == 93 * 16
    assert idf[neardup.cell(h[row == 0])].max() < 0.75 < 3 < np.median(idf[neardup.cell(h[row > 0])])


def test_bands_join_samples_of_one_kind():
    assert len(neardup.BANDS) == neardup.WEIGHTED + neardup.HASHES and all(len(set(b)) == 3 and len({i < neardup.WEIGHTED for i in b}) == 1 for b in neardup.BANDS)
