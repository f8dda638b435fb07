"""Problem 7: against brute force, and offsets in the original."""

import random

import pytest

from corpusmill.llm import leaks

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_matches_brute_force(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 13, 20, 40])))) for k in range(25)]
    items += [(90, items[4][1]), (91, None), (92, ""), (93, " ?! ")]
    docs = []
    for k in range(120):
        t = [r.choice(words) for _ in range(30)]
        w = r.choice(items[:25])[1].split()
        a = r.randrange(len(w))
        t[10:10] = w[a : a + r.choice([5, 12, 13, 14, 40])]
        docs.append((k, r.choice([" ", "  ", ", ", " - "]).join(t)))
    docs += [(500, None), (501, ""), (502, "  "), (0, docs[0][1])]
    want = set()
    for d, t in docs:
        line = " " + " ".join(leaks.words(t or "")) + " "
        for i, x in items:
            w = leaks.words(x or "")
            if w and any(" " + " ".join(w[k : k + 13]) + " " in line for k in range(max(1, len(w) - 12))):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id"), spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id")
    got = [tuple(x) for x in leaks.found(dd, "doc_id", "text", ii, "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spans = leaks.found(dd, "doc_id", "text", ii, "item_id", "text", spans=True).collect()
    assert {(s.doc_id, s.item_id) for s in spans} == want
    text = dict(docs[:120])
    for s in spans:
        piece = leaks.words(text[s.doc_id][s.start_at : s.end_at])
        assert len(piece) == s.words


@pytest.mark.parametrize("text", ["THE QUICK brown-fox", "ｔｈｅ　quick brown\nfox", "the qu­ick br​own fox!", "thе quiсk brоwn fоx", "say: the quick... brown FOX?"])
def test_looks_do_not_count(spark, text):
    items = spark.createDataFrame([(7, "The quick brown fox")], ITEMS)
    docs = spark.createDataFrame([(1, text), (2, "the quick brown foxes"), (3, "the quïck brown fox"), (4, "the quick red brown fox")], DOCS)
    got = leaks.found(docs, "doc_id", "text", items, "item_id", "text", spans=True).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]
    assert leaks.words(text[got[0].start_at : got[0].end_at]) == ["the", "quick", "brown", "fox"]


def test_items_beyond_one_automaton_are_searched_in_parts(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(12)]
    docs = [(k, f"before {items[k % 12][1]} between {items[(k + 5) % 12][1][: r.randrange(40, 80)]} behind") for k in range(30)]
    dd, ii = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole, parts = ({tuple(x) for x in leaks.found(dd, "doc_id", "text", ii, "item_id", "text", spans=True, items_mb=mb).collect()} for mb in (8, 0.0004))
    assert whole == parts and {(k, k % 12) for k in range(30)} <= {x[:2] for x in whole}


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b " * 50_000)], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert leaks.found(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.found(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leaks.found(docs, "doc_id", "text", items, "item_id", "text").count() == 1
