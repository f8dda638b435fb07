"""Problem 3: literal pages, and accuracy on clean records made noisy."""

import random

import pytest

from corpusmill.llm import scans
from corpusmill.sources.tables import table

SCHEMA = "rec_table string, rec_id string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, "/root/testdata/sf0.01", "clean_result").selectExpr("'clean_result' AS rec_table", "CAST(rec_id AS string) AS rec_id", "text")


@pytest.fixture(scope="module")
def lexicon(corpus):
    return scans.learn(corpus, "text")


@pytest.fixture(scope="module")
def clean_text(corpus, lexicon):
    rows = [r.text for r in corpus.collect() if r.text and len(r.text) > 500 and "\n" in r.text and max(map(len, r.text.split("\n"))) > 150]
    return [t.replace("\n", " ") for t in rows if not scans.Record(t, lexicon).noise][:60]


def wrap(text, width=70):
    import textwrap

    return textwrap.wrap(text, width, break_on_hyphens=False)


def test_lines_alone_are_no_noise(lexicon, clean_text):
    for t in clean_text[:30]:
        r = scans.Record("\n".join(wrap(t)), lexicon)
        assert not r.noise and r.text().replace("\n", " ") == t


def test_hyphens_pages_and_headers_are_undone(lexicon, clean_text):
    bad = 0
    for n, t in enumerate(clean_text[:30]):
        lines, out, want = wrap(t), [], {"page_number", "header"}
        for k, line in enumerate(lines):
            last = line.rsplit(" ", 1)[-1]
            if k + 1 < len(lines) and len(last) > 7 and last.isalpha() and k % 2:
                line, lines[k + 1] = line[:-4] + "-", last[-4:] + " " + lines[k + 1]
                want.add("hyphen")
            out.append(line)
            if k % 4 == 2:
                out += [f"- {n + k} -", "OPINIONS OF THE DRIVING APPELLATE DIVISION"]
        r = scans.Record("\n".join(out), lexicon)
        bad += r.text().replace("\n", " ") != t or r.noise != want
    assert bad <= 1


def test_misread_letters_are_undone(lexicon, clean_text):
    r, found, same = random.Random(2), 0, 0
    for t in clean_text[:30]:
        words = t.split(" ")
        at = [i for i, w in enumerate(words) if w.isalpha() and w.islower() and len(w) > 5 and lexicon.known_word(w)]
        for i in r.sample(at, 6):
            w = words[i]
            words[i] = r.choice([w[:3] + " " + w[3:], w.replace("e", "c", 1), w[:2] + "|" + w[2:], w[:3] + w[3].upper() + w[4:], w.replace("i", "1", 1)])
        rec = scans.Record(" ".join(words), lexicon)
        found += "glyph" in rec.noise
        a, b = rec.text().replace("\n", " ").split(), t.split()
        same += sum(x == y for x, y in zip(a, b)) / len(b) > 0.99
    assert found >= 27 and same >= 24


def test_a_damaged_text_in_a_third_of_the_rows_is_no_evidence_of_its_words(spark, corpus, clean_text, lexicon):
    r, t = random.Random(3), clean_text[0]
    words = t.split(" ")
    at = [i for i, w in enumerate(words) if w.isalpha() and w.islower() and len(w) > 6 and lexicon.known_word(w)]
    for n, i in enumerate(r.sample(at, 8)):
        w = words[i]
        words[i] = w[:3] + "|" + w[3:] if n % 2 else w[:3] + "-\n" + w[3:]
    bad = " ".join(words)
    want = scans.Record(bad, lexicon)
    copies = spark.createDataFrame([("clean_result", f"copy{k}", bad) for k in range(corpus.count() // 2)], SCHEMA)
    got = scans.Record(bad, scans.learn(corpus.unionByName(copies), "text"))
    assert want.noise == got.noise == {"glyph", "hyphen"} and want.text() == got.text()


def test_a_frequent_title_hides_no_other():
    shapes = {"A ^of A #": (1_000_000, 0), "A ^trust A #": (900, 10), "^a A ^unit #": (3, 1), "^a A ^page": (2, 0), "^the X ^rule": (500, 900)}
    assert scans.Lexicon({}, 0, {}, {}, shapes).frames == {"A ^of A #", "A ^trust A #", "^a A ^unit #"}


@pytest.mark.parametrize("damage, least, most", [(lambda w: w[:3] + " " + w[3:], 29, 30), (lambda w: w[:2] + "|" + w[2:], 28, 30), (lambda w: w.replace("e", "c", 1), 28, 30), (lambda w: w[:2] + w[2:4][::-1] + w[4:], 0, 0), (lambda w: w[:3] + w[4:], 0, 2)])
def test_a_single_misread_counts_and_a_typing_error_does_not(lexicon, clean_text, damage, least, most):
    found = 0
    for t in clean_text[:30]:
        words = t.split(" ")
        i = next(i for i, w in enumerate(words) if i > 20 and w.isalpha() and w.islower() and len(w) > 6 and "e" in w and w[2] != w[3] and lexicon.known_word(w))
        found += "glyph" in scans.Record(" ".join([*words[:i], damage(words[i]), *words[i + 1 :]]), lexicon).noise
    assert least <= found <= most


def test_lost_blanks_are_put_back_and_are_no_noise(lexicon):
    r = scans.Record("the courtfound that thelease was part ofthe record", lexicon)
    assert r.text() == "the court found that the lease was part of the record" and not r.noise
    assert scans.Record("Courtfound and Ashgrovebank stay names", lexicon).text() == "Courtfound and Ashgrovebank stay names"


def test_cleaned_text_is_the_printed_text(lexicon, clean_text):
    """All kinds of noise at once: at least 95 % of the words come out as they were printed, in order."""
    import difflib

    r, right, total, whole = random.Random(11), 0, 0, 0
    for n, t in enumerate(clean_text):
        words = t.split(" ")
        at = [i for i, w in enumerate(words) if w.isalpha() and w.islower() and len(w) > 5 and lexicon.known_word(w)]
        for i in r.sample(at, 5):
            w = words[i]
            words[i] = r.choice([w[:3] + " " + w[3:], w.replace("e", "c", 1), w[:2] + "|" + w[2:], w.replace("i", "1", 1)])
        i = next(i for i in at if words[i + 1].isalpha() and words[i + 1].islower() and lexicon.known_word(words[i]))
        words[i : i + 2] = [words[i] + words[i + 1]]
        lines, out = wrap(" ".join(words)), []
        for k, line in enumerate(lines):
            last = line.rsplit(" ", 1)[-1]
            if k + 1 < len(lines) and len(last) > 7 and last.isalpha() and k % 3 == 0:
                line, lines[k + 1] = line[:-4] + "-", last[-4:] + " " + lines[k + 1]
            out.append(line)
            if k % 6 == 4:
                out += [f"- {n + k} -", "OPINIONS OF THE DRIVING APPELLATE DIVISION"]
        got, want = scans.Record("\n".join(out), lexicon).text().split(), t.split()
        same = sum(m.size for m in difflib.SequenceMatcher(None, got, want, autojunk=False).get_matching_blocks())
        right, total, whole = right + same, total + max(len(got), len(want)), whole + (got == want)
    print(f"words right {right / total:.4f}, texts whole {whole / len(clean_text):.2f}")
    assert right >= 0.98 * total


@pytest.mark.parametrize("text", ["Lesson 1: How Rivers Move\nThe court found that the lease was void. It said so on page 12 of the record.", "for pre-\nand post-closing purposes", "42. The court found it.\n43. The jury did not.", "under section 88 of the rules of 1990"])
def test_no_noise(lexicon, text):
    assert not scans.Record(text, lexicon).noise


def test_swapped_letters_are_no_misreading(lexicon):
    assert "glyph" not in scans.Record("the coutr had the mottion and the judgmetn of the coutr", lexicon).noise


def test_nulls_blanks_repeats_and_empty_tables(spark):
    rows = [("p", "1", None), ("p", "2", ""), ("p", "3", " \n "), ("p", None, "text"), ("p", "4", "a\n- 3 -\nb c"), ("p", "4", "a\n- 3 -\nb c"), ("p", "5", "word " * 60_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS noise", "1 AS kind")
    got = {(r.rec_id, r.text if len(r.text or "") < 99 else "long", tuple(r.noise)) for r in scans.cleaned(df).collect()}
    assert got == {("1", None, ()), ("2", "", ()), ("3", " \n ", ()), ("4", "a b c", ("page_number",)), ("5", "long", ())}
    assert [tuple(r) for r in scans.found(df).collect()] == [("p", "4", "page_number")]
    assert scans.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shapes_beyond_those_in_memory_are_all_looked_up(spark, corpus, lexicon, monkeypatch):
    texts = [f"The court of the state found that the lease was void in the\nTHE {a} OF {b} {n}\nmatter of the court and that the bank and the state had not" for n, (a, b) in enumerate([("COURT", "STATE")] * 4 + [("STATE", "BANK")] * 3 + [("LEASE", "COURT")] * 2)]
    texts += [f"The court found this in the case.\nThe Lease Of The State {n}\nThe bank and the state had not said so in the case." for n in range(4)]
    df = corpus.unionByName(spark.createDataFrame([("p", f"t{k}", t) for k, t in enumerate(texts)] + [("p", "inline", "the matter of the court " * 6 + "THE STATE OF BANK 7 and the bank " + "THE STATF OF BANK 8 and the bank")], SCHEMA))
    full, want = scans.learn(df, "text"), {tuple(r) for r in scans.found(df).collect()}
    monkeypatch.setattr(scans, "SHAPES", 2)
    few = scans.learn(df, "text")
    assert len(full.shapes) > 10 and len(full.frames) > 1 and full.starts and full.capital_frames
    for x in [*full.shapes, "no such ^shape", ""]:
        assert few.title_share(x) == full.title_share(x) and (x in few.frames) == (x in full.frames)
        for k in (x.split(), x.split()[1:], [*x.split()[:1], "A", *x.split()[2:]]):
            assert few.capital_frame(k) == full.capital_frame(k) and (tuple(k[:2]) in few.starts) == (tuple(k[:2]) in full.starts)
    assert {tuple(r) for r in scans.found(df).collect()} == want
    assert ("p", "t0", "header") in want
