"""Problem 6: against the vocabulary's own library, and an exact round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe_automaton as B

PATH = f"{B.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(texts):
    at, flat = B.encode_texts(texts, PATH)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aeit hn's\n\t 0-=", max_size=60)), max_size=5))
def test_equals_the_library(texts):
    t = __import__("tokenizers").Tokenizer.from_file(PATH) if not hasattr(test_equals_the_library, "t") else test_equals_the_library.t
    test_equals_the_library.t = t
    t.encode_special_tokens = True
    assert ids(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    auto = B.words_of(PATH).automaton
    assert [auto.decode(x) for x in ids(texts)] == texts


def test_long_and_odd_words(library):
    texts = ["a" * 5000, "=-" * 3000, "ab" * 999 + "\U0001f642" * 50, "<|endoftext|>", "\xa0 x\x1c y"]
    assert ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_automaton_of_a_toy_vocabulary():
    pieces = [b"a", b"b", b"aa", b"ab", b"aab", b"aaaa"]
    ids_ = {bytes([k]): k for k in range(256)} | {p: 256 + i for i, p in enumerate(pieces[2:])}
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"aa", b"aa")]
    auto = B.TokenAutomaton(ids_, merges)

    def by_merging(w):
        parts = [bytes([x]) for x in w]
        for a, b in merges:
            out, k = [], 0
            while k < len(parts):
                if parts[k : k + 2] == [a, b]:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return tuple(ids_[p] for p in parts)

    for n in range(9):
        for x in range(2**n):
            w = bytes(97 + (x >> k & 1) for k in range(n))
            assert auto.encode_word(w) == by_merging(w), w


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "word"), (4, "word"), (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS __key")
    got = sorted((r.doc_id or 0, r.ids) for r in B.encode(df, "doc_id", "text").collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4] and got[1][1] == got[2][1] == [] and len(got[3][1]) == 1
    back = {r.doc_id: r.text for r in B.decode(B.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back[4] == "word" and back[1] == ""
    assert B.encode(df.limit(0), "doc_id", "text").count() == 0
