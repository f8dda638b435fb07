"""Problem 8: one form of equal readings, and none of different ones."""

import random
import unicodedata

import pytest

from corpusmill.llm import homoglyphs
from corpusmill.llm.lookalikes import reading

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("a, b", [("county", "соuntу"), ("Ｆｕｌｌ１２", "Full12"), ("de­fi​ne", "define"), ("a b　c", "a b c"), ("é", "é"), ("ﬁne aﬃx", "fine affix"), ("Kelvin Å", "Kelvin Å"), ("Тһе", "The"), ("ё", "ë"), ("e‍́", "é"), ("a‑b", "a-b"), ("\U0001d401\U0001d428ld", "Bold"), ("\u13aa\ua4f3", "AO")])
def test_equal_readings(a, b):
    assert reading(a) == reading(b)


@pytest.mark.parametrize("a, b", [("resume", "résumé"), ("Case", "case"), ("12", "13"), ("a\nb", "a b"), ("a  b", "a b"), ("ß", "ss"), ("l", "I")])
def test_different_readings(a, b):
    assert reading(a) != reading(b)


def test_speller_prefers_ascii_then_frequency():
    s = homoglyphs.Speller([("сосед", 50), ("cocед", 2), ("résumé", 9)])
    assert s.token("сoсед") == "сосед" and s.token("rе́sumе́") == "résumé" and s.token("рау") == "pay"
    assert s.match("resume") is None and s.match("r\u00ad\u0435sum\u00e9") is None and s.match("r\u00e9\u00adsum\u00e9") == "résumé"


def test_vocabulary_decides_between_letters_drawn_alike():
    """The table reads palochka as I and upsilon as u; the corpus' words know better."""
    s = homoglyphs.Speller([("long", 5), ("service", 9), ("up", 3), ("vp", 80), ("Irk", 1), ("\u04c0ong", 70), ("seruice", 1)])
    assert s.token("\u04c0ong") == "long" and reading("\u04c0ong") == "Iong"
    assert s.token("\u03c5p") == "up", "the first reading goes before a more frequent word"
    assert s.token("ser\u03c5ice") == "seruice" and s.token("\u04c0rk") == "Irk" and s.token("\u04c0x") == "Ix"
    assert homoglyphs.Speller([("long", 5)], only=True).text("a \u04c0\u043eng \u0440\u0430\u0443 day") == "a long \u0440\u0430\u0443 day"


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_pairs_that_the_table_alone_misses(spark, size):
    """Texts whose letters have several readings are found equal by the vocabulary, in one part or in many, and those of the table's reading stay apart from them."""
    rows = [(1, "the long service of the county"), (2, "the \u04c0ong service of the county"), (3, "the long ser\u03c5ice of the county"), (4, "the l\u200bong service of the c\u043eunty"), (5, "illegal  \u01c0and"), (6, "illegal  land")]
    df = spark.createDataFrame(rows, SCHEMA)
    form = {x.doc_id: x.text for x in homoglyphs.canonical(df, "doc_id", "text", size=size).collect()}
    assert form == {1: rows[0][1], 2: rows[0][1], 3: rows[0][1], 4: rows[0][1], 5: "illegal  land", 6: "illegal  land"}
    table = {k: reading(t) for k, t in rows}
    assert table[2] != table[1] and table[3] == "the long seruice of the county" and table[4] == table[1]
    got = {tuple(x) for x in homoglyphs.pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)}


def test_pairs_and_classes(spark):
    r = random.Random(1)
    base = [f"The county of Orrin{k} paid the naïve clerk {k} crowns.\nIt was final." for k in range(12)]
    odd = {"a": "а", "e": "е", "o": "о", "c": "с"}

    def alter(t):
        k = r.randrange(4)
        if k == 0:
            return "".join(odd.get(c, c) if r.random() < 0.5 else c for c in t)
        if k == 1:
            return "".join(c + "​" if r.random() < 0.2 else c for c in t)
        return unicodedata.normalize("NFD", t) if k == 2 else t.replace(" ", " ")

    rows = [(k, r.choice(base) if r.random() < 0.5 else alter(r.choice(base))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, " ​"), (203, " "), (0, rows[0][1]), (204, "x" * 200_000 + "е"), (205, "x" * 200_000 + "e")]
    text = {k: t for k, t in rows if t and reading(t).strip()}
    want = {(a, b) for a in text for b in text if a < b and text[a] != text[b] and reading(text[a]) == reading(text[b])}
    df = spark.createDataFrame([*rows, (None, rows[0][1])], SCHEMA).selectExpr("*", "1 AS form", "2 AS raw", "3 AS k")
    got = [tuple(x) for x in homoglyphs.pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    c = {x.doc_id: x.class_id for x in homoglyphs.classes(df.where("doc_id IS NOT NULL"), "doc_id", "text").collect()}
    assert set(c) == set(text) and all((c[a] == c[b]) == (reading(text[a]) == reading(text[b])) for a in text for b in text)
    form = {x.doc_id: x.text for x in homoglyphs.canonical(df, "doc_id", "text").collect()}
    assert form[200] is None and form[201] == "" and all(form[a] == form[b] for a, b in want)
    star = {tuple(x) for x in homoglyphs.pairs(df, "doc_id", "text", all_pairs=3).collect()}
    assert star <= want and {x for p in want for x in p} == {x for p in star for x in p}


def test_a_class_of_many_copies_and_variants_gives_all_pairs(spark):
    odd = {"a": "а", "e": "е", "o": "о", "c": "с"}
    base = "a clerk once read the whole record"
    variants = [base, *(base.replace(a, b) for a, b in odd.items()), base.replace(" ", "\u2003")]
    rows = [(k, variants[0] if k % 2 else variants[k // 2 % 6]) for k in range(90)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(x) for x in homoglyphs.pairs(df, "doc_id", "text", all_pairs=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    c = homoglyphs.classes(df, "doc_id", "text").collect()
    assert {x.class_id for x in c} == {0} and {(a.doc_id, b.doc_id) for a in c for b in c if a.doc_id < b.doc_id and a.raw != b.raw} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert homoglyphs.pairs(empty, "doc_id", "text").count() == 0 and homoglyphs.canonical(empty, "doc_id", "text").count() == 0
