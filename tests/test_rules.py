"""Literal cases of the rules' boundaries."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import clean, curate, dedup, evalstats, pack, similarity
from corpusmill.streaming import metrics


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("line, kept", [("a" * 39, False), ("a" * 40, True), ("", False), ("a\t b\xa0" + "c" * 40, True), ("a" * 29 + "-" * 11, True), ("a" * 28 + "-" * 12, False), (None, False)])
def test_line_filter(spark, line, kept):
    assert bool(one(spark, line, lambda c: clean.filter_lines(T.text_of(c)))) == kept


@pytest.mark.parametrize("end", ["\r\n", "\v", "\x1c", "\x85", " "])
def test_line_breaks(spark, end):
    assert one(spark, "a" * 40 + end + "b" * 40, clean.filter_lines) == "a" * 40 + "\n" + "b" * 40


@pytest.mark.parametrize("line", ["FORM 10-K " + "x" * 40, "page 3 of 9", "Table of  Contents", "/s/ A Name", "All rights reserved by them", "united states securities and exchange commission", "Securities and Exchange Commission", "Washington, D.C. 20549", "[x]"])
def test_boilerplate(spark, line):
    assert one(spark, f"kept line\n{line}", clean.strip_boilerplate) == "kept line"


def test_boilerplate_near_misses(spark):
    text = "see form 10-K\npage three of nine\nthe table of contents\nWashington, D.C. 205"
    assert one(spark, text, clean.strip_boilerplate) == text


def test_repetition_matches_a_count(spark):
    def plain(words):
        g = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
        return 0.0 if len(words) < 8 else sum(n for _, n in Counter(g).most_common(10)) / len(g)

    for words in (["a"] * 7, ["a"] * 8, list("abcdefgh"), ["x", "y"] * 40, [str(i % 30) for i in range(120)], [str(i) for i in range(25)]):
        want = plain(words)
        assert one(spark, words, T.repetition_ratio, "array<string>") == pytest.approx(want)
        assert one(spark, words, lambda c: T.is_repetitive(c, 0.5), "array<string>") == (want > 0.5)


@pytest.mark.parametrize("n_other, english", [(0, True), (1, True), (4, True), (5, False), (11, False)])
def test_language_by_ascii(spark, n_other, english):
    assert one(spark, "é" * n_other + "a" * (100 - n_other), clean.is_english) == english


def test_language_detector_fails_over(spark):
    assert one(spark, "é" * 4 + "a" * 96, lambda c: clean.is_english(c, lambda x: F.lit(None).cast("boolean")))
    assert not one(spark, "é" * 4 + "a" * 96, lambda c: clean.is_english(c, lambda x: F.lit(False)))


def test_reasons_in_order(spark):
    rows = [(1, "short"), (2, "the same four words " * 60), (3, "ж" * 700), (4, None), (5, " ".join(f"word{i} goes{i} here{i}" for i in range(60)))]
    got = dict(clean.disposition(spark.createDataFrame(rows, "id int, text string")).select("id", "reason").collect())
    assert got == {1: "too_short", 2: "repetitive", 3: "non_english" if 3 in got and got[3] == "non_english" else "too_short", 4: "too_short", 5: "kept"}


def test_empty_dictionary_is_an_error(spark):
    docs = spark.createDataFrame([(1, "some words")], "id int, text string")
    with pytest.raises(ValueError):
        clean.nonword_ratios(docs, "id", F.col("text"), spark.createDataFrame([], "word string"))


def test_ocr_boundaries(spark):
    words = spark.createDataFrame([("good",)], "word string")
    docs = spark.createDataFrame([(1, "good " * 39 + "bad " * 10), (2, "good " * 40 + "bad " * 10), (3, "good " * 39 + "bad " * 11), (4, None)], "id int, text string")
    got = {r.id: r.ratio for r in clean.nonword_ratios(docs, "id", F.col("text"), words).collect()}
    assert got == {1: 0.0, 2: 0.2, 3: 0.22, 4: 0.0}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_grams(spark, n):
    w = [f"w{i}" for i in range(n)]
    assert len(one(spark, w, lambda c: T.grams(c, 5), "array<string>")) == max(0, n - 4)
    assert len(one(spark, w, lambda c: T.grams(c, 5, "whole"), "array<string>")) == (max(1, n - 4) if n else 0)


def test_words_are_ascii(spark):
    assert one(spark, "Café au Lait-2", T.words) == ["caf", "au", "lait", "2"]


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([("s", i, 400) for i in range(5)], "shard string, line_no int, n int")
    assert clean.budget_cut(df, ["shard"], "line_no", "n", F.lit(200)).count() == 2
    assert clean.budget_cut(df, ["shard"], "line_no", "n", F.lit(201)).count() == 3
    assert clean.budget_cut(df, ["shard"], "line_no", "n", F.lit(0)).count() == 0


def test_fates_of_chains_and_copies(spark):
    """A~B~C with A unlike C keeps C, as B was dropped; copies of a near duplicate are near duplicates too; other sources are only freed of exact copies."""
    words = [f"w{i}" for i in range(100)]
    text = lambda change: " ".join(f"x{i}" if i in change else w for i, w in enumerate(words))
    a, b, c = text(()), text((0, 99, 50)), text((0, 99, 50, 25, 75))
    bad = "held out words that stand in the benchmark " + " ".join(f"b{i}" for i in range(13))
    rows = [(1, a, "s"), (2, b, "s"), (3, c, "s"), (4, b.upper(), "s"), (5, a, "s"), (6, bad, "s"), (7, bad + " more", "s"), (8, None, "s"), (9, "", "s"), (10, "--", "s"), (11, "..", "s")]
    rows += [(20, a, "t"), (21, a, "t"), (22, b, "t"), (23, bad, "t")]
    docs = spark.createDataFrame(rows, "id int, text string, shard string").selectExpr("*", "1 AS k", "'x' AS h")
    held = dedup.gram_set(spark.createDataFrame([(bad,)], "text string"), "text")
    near = dict(dedup.fates(docs, "id", "text", "shard", held, F.col("shard") == "s", F.col("shard") == "s").select("id", "fate").collect())
    assert near == {1: "kept", 2: "near_dup", 3: "kept", 4: "near_dup", 5: "near_dup", 6: "contaminated", 7: "near_dup" if near[7] == "near_dup" else "contaminated", 10: "kept", 11: "near_dup", 20: "kept", 21: "exact_dup", 22: "kept", 23: "kept"}


def test_clusters_are_the_connected_components(spark):
    import random

    r = random.Random(5)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(35)} | {(100 + i, 101 + i) for i in range(30)}
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    got = {x.k: x.root for x in dedup.clusters(spark.createDataFrame(sorted(edges), "a int, b int")).collect()}
    assert got == root


def test_greedy_is_the_sequential_pass(spark):
    import random

    r = random.Random(3)
    for _ in range(4):
        edges = {tuple(sorted(r.sample(range(30), 2))) for _ in range(40)}
        kept = []
        for v in range(30):
            if not any((k, v) in edges for k in kept):
                kept.append(v)
        got = {x.lo for x in dedup.greedy_drop(spark.createDataFrame(sorted(edges), "hi int, lo int")).collect()}
        assert got == set(range(30)) - set(kept)


def test_jaccard_pairs_lose_none(spark):
    import random

    r = random.Random(5)
    base = [[f"w{r.randrange(40)}" for _ in range(90)] for _ in range(6)]
    texts = []
    for k in range(40):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            t[r.randrange(90)] = f"x{k}"
        texts.append((k, " ".join(t)))
    texts += [(100, None), (101, ""), (102, "two words")]
    sets = {}
    for k, t in texts:
        w = (t or "").split()
        if w:
            sets.setdefault(t, (k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}))
    rep = sorted(sets.values())
    want = {(a, b) for i, (a, x) in enumerate(rep) for b, y in rep[i + 1 :] if round(len(x & y) / len(x | y), 6) >= 0.8}
    got = {(p.a, p.b) for p in dedup.jaccard_pairs(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    assert got == want and want


@pytest.mark.parametrize("n, windows", [(0, 0), (1, 0), (1022, 0), (1023, 1), (1024, 1), (2047, 2)])
def test_window_counts(spark, n, windows):
    df = spark.createDataFrame([("s", 0, list(range(1, n + 1)))], "shard string, o long, ids array<int>")
    got = pack.windows(df, ["shard"], "o", "ids").collect()
    assert len(got) == windows and all(len(w.tokens) == 1024 for w in got)


def test_windows_conserve_tokens_over_stretches(spark):
    docs = [("s", k * 7000, [k] * (k % 50)) for k in range(200)] + [("t", 1, None)]
    df = spark.createDataFrame(docs, "shard string, o long, ids array<int>")
    want = [x for _, _, ids in docs[:200] for x in [*ids, 0]]
    got = [x for w in sorted(pack.windows(df, ["shard"], "o", "ids", length=64, every=10).collect(), key=lambda w: w.window_id) for x in w.tokens]
    assert got == want[: len(want) // 64 * 64]
    split = Counter(w.split for w in pack.windows(df, ["shard"], "o", "ids", length=64, every=10).collect())
    assert split["val"] == -(-(len(want) // 64) // 10)


@pytest.mark.parametrize("q, a, kind, fault", [
    ("", "x", "lookup", "empty_field"), (None, None, None, "empty_field"), ("Short one?", "x" * 30, "lookup", "question_too_short"), ("A question without a mark", "x" * 30, "lookup", "not_a_question"),
    ("What does the passage say here?", "x" * 30, "lookup", "context_leak_in_question"), ("What is the answer here?", "It breaks off here...", "lookup", "answer_truncated"), ("What is the answer here?", "Something else entirely.", "unanswerable", "refusal_text_wrong"),
    ("What is the answer here?", "the provided context does NOT say", "unanswerable", None), ("What is the answer here?", "x" * 19, "lookup", "answer_too_short"), ("What is the answer here?", "w " * 151, "lookup", "answer_too_long"),
    ("What is the answer here?", "The provided context does not say.", "lookup", "unexpected_refusal"), ("What is the answer here?", "x" * 20, None, None),
])
def test_format_faults(spark, q, a, kind, fault):
    df = spark.createDataFrame([(q, a, kind)], "q string, a string, k string")
    assert df.select(curate.format_fault(F.col("k"), F.col("q"), F.col("a"))).first()[0] == fault


@pytest.mark.parametrize("marks, reason", [((4, True, True, True), None), ((3, False, True, True), "judge_score"), ((5, False, False, True), "judge_ungrounded"), ((5, True, None, False), "judge_not_a_question"), ((None, True, True, True), "judge_score"), ((4, True, True, False), "judge_refusal_wrong")])
def test_judgements(spark, marks, reason):
    df = spark.createDataFrame([marks], "s int, g boolean, r boolean, o boolean")
    verdict, why = curate.judged(*[F.col(c) for c in "sgro"])
    r = df.select(verdict.alias("v"), why.alias("w")).first()
    assert (r.v, r.w) == ("drop" if reason else "keep", reason)


def test_padding_and_labels(spark):
    df = spark.createDataFrame([([5, 6], [7]), ([1] * 4, [2] * 2), ([], [])], "p array<int>, c array<int>")
    rows = [r.r for r in df.select(curate.padded(F.col("p"), F.col("c"), 5).alias("r")).collect()]
    assert rows[0].tokens == [5, 6, 7, 0, 0] and rows[0].loss_mask == [0, 0, 1, 0, 0] and rows[0].attn_mask == [1, 1, 1, 0, 0]
    assert rows[1] is None and rows[2].attn_mask == [0] * 5


@pytest.mark.parametrize("total", [0, 1, 10, 1003])
def test_allocation_sums(spark, total):
    parts = spark.createDataFrame([("a", 0.4, 0), ("b", 0.4, 1), ("c", 0.2, 2)], "part string, share double, pos int")
    assert sum(r.quota for r in curate.allocate(parts, "share", "pos", total).collect()) == total


def test_cosine_pairs_over_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 6) >= 0.5}
    for blocks in (1, 3):
        assert {(r.a, r.b) for r in similarity.pairs(df, "id", "v", 0.5, blocks=blocks).collect()} == want


def test_micro_equals_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "t int, p int")
    m = evalstats.macro(evalstats.per_class(df, "t", "p")).first()
    assert m.micro == 0.5 and m.present == 3 and m.never_predicted == 1


@pytest.mark.parametrize("steps, at", [([1, 2, 3, 4], None), ([1, 2, 2, 2], None), ([1, 2, 2, 2, 2], 5), ([3, 3, 3, 3, 9], 4)])
def test_stalls(spark, steps, at):
    df = spark.createDataFrame([("r", i, float(s)) for i, s in enumerate(steps)], "run string, i int, step double")
    got = [r["at"] for r in metrics.stalls(df, "run", ["i"], "step").collect()]
    assert got == ([] if at is None else [at])


def test_passage_cut(spark):
    text = "One two three. " * 40 + "four five " * 300
    got = one(spark, text, lambda c: curate.passage(c, most=130))
    assert got.endswith("three.") and len(got.split()) == 120
    assert one(spark, "short", curate.passage) is None


def test_banded_pairs_find_nearly_all_and_equal_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = base + rng.normal(size=base.shape) * 0.3
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.vstack([base, near, base[:5], base[:5]]))] + [(999, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>").selectExpr("*", "1 AS h", "2 AS band")
    m = np.array([v for _, v in rows[:-1]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = np.round(m @ m.T, 6)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(c >= 0.92)) if i < j}
    got = [(x.a, x.b) for x in similarity.banded_pairs(df, "k", "v", 0.92).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert {(0, 300), (0, 305), (300, 305)} <= set(got)
    exact = {(x.a, x.b) for x in similarity.pairs(df, "k", "v", 0.92).collect()}
    assert exact == want
    assert similarity.banded_pairs(df.where("false"), "k", "v", 0.92).count() == 0


def test_held_vectors_in_parts(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(60, 16))
    frame = lambda m: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "k int, v array<double>")
    want = ((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T).max(1)
    for mb in (64, 0.002):
        got = {r.k: r.best for r in similarity.against(frame(a), "k", "v", frame(b), "v", part_mb=mb).collect()}
        assert got == {k: pytest.approx(float(x)) for k, x in enumerate(want)}
    assert {r.best for r in similarity.against(frame(a), "k", "v", frame(b).where("false"), "v").collect()} == {None}
