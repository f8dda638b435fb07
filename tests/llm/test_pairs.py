"""Problem 2: held-out accuracy of the classifier, and hard cases."""

import random

import pytest

from corpusmill.llm import pairs
from corpusmill.sources.tables import table

SCHEMA = "id string, type string, question string, answer string, context string"


@pytest.fixture(scope="module")
def sample(spark):
    rows = table(spark, "/root/testdata/sf0.1", "candidate").select("type", "question", "answer", "context").collect()
    random.Random(1).shuffle(rows)
    return [tuple(r) for r in rows if r.question]


@pytest.fixture(scope="module")
def model(sample):
    return pairs.train(sample[:2500])


def label(model, rows):
    s = model.scores([pairs.features(q, a, c, model.known) for _, q, a, c in rows])
    k = model.defect(s, __import__("numpy").array([t == "unanswerable" for t, *_ in rows], bool))
    return [pairs.LABELS[x] if x >= 0 else None for x in k]


def test_held_out_defects_are_found(model, sample):
    make = pairs.Defects(99)
    whole = [r for r in sample[4000:] if r[2] and r[2].rstrip().endswith(".") and len(r[2]) > 40 and r[0] == "lookup" and "?" in r[1] and r[1].isascii() and r[2].isascii() and pairs.languages(r[2]).most_common(1)[0][0] == "en"][:400]
    sound = label(model, whole)
    assert sum(x is not None for x in sound) < 0.16 * len(whole)  # real pairs, some of which are refusals
    cut = [(t, q, x, c) for t, q, a, c in whole if (x := make.truncated(a))]
    assert sum(x == "truncated_answer" for x in label(model, cut)) > 0.9 * len(cut)
    for name, f in (("empty_answer", lambda q: make.empty()), ("copied_question", make.copied)):
        got = label(model, [(t, q, f(q), c) for t, q, a, c in whole])
        assert sum(x == name for x in got) > 0.9 * len(got), name


@pytest.mark.parametrize("question, answer, kind, defect", [
    ("When does the lease of Orrin Trust expire?", "I'm sorry, but I cannot answer this question.", "lookup", "refusal"), ("When does the lease of Orrin Trust expire?", "The provided context does not say.", "unanswerable", None), ("When does the lease of Orrin Trust expire?", "The provided context does not say.", None, "refusal"),
    ("What did Orrin reply when asked about the lease?", 'Orrin replied "I do not know" and left the stand on 3 May 1990.', "lookup", None), ("When does the lease of Orrin Trust expire?", "Q: When does the lease of Orrin Trust expire?", "lookup", "copied_question"),
    ("When does the lease of Orrin Trust expire?", "El contrato de la empresa se firmó en el año 1990 por el juez de la región.", "lookup", "other_language"), ("Which pamphlet did Orrin publish about the mill race?", 'Orrin published "Le bail de la forêt" in 20 copies.', "lookup", None),
    ("When does the lease of Orrin Trust expire?", "n/a", "lookup", "empty_answer"), ("When does the lease of Orrin Trust expire?", "​ ", "lookup", "empty_answer"), ("When does the lease of Orrin Trust expire?", None, None, "empty_answer"), (None, None, None, "empty_answer"),
])
def test_literal_cases(spark, model, monkeypatch, question, answer, kind, defect):
    monkeypatch.setattr(pairs, "train", lambda rows, seed=7: model)
    df = spark.createDataFrame([("a", kind, question, answer, "The lease of Orrin Trust expires soon."), (None, kind, question, answer, None)], SCHEMA).selectExpr("*", "'x' AS defect")
    got = pairs.defects(df.union(df)).collect()
    assert [(r.id, r.defect) for r in got] == ([("a", defect)] if defect else [])


def test_empty_table_and_long_answers(spark):
    assert pairs.defects(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("a", "lookup", "What is it about?", "word " * 50_000 + "end.", None), ("b", "lookup", "What?", None, None)], SCHEMA)
    assert ("b", "empty_answer") in [tuple(r) for r in pairs.defects(df).collect()]
