"""Problem 8: one consistent form of texts that read the same.

The corpus' own words are the vocabulary. Each worker holds them as a trie
under their readings, and walks it along each token that has a character beyond
ASCII: a weighted edit automaton in which unseen characters, and arcs whose
characters look like the token's, cost nothing, and nothing else is allowed. A
letter drawn like several others has several arcs, so that the vocabulary's
words decide what it is ("\u04c0ong" is "long", where the corpus has that word
and not "Iong"). The word of a token's first reading is its spelling, else the
most frequent one in ASCII at the end of its walks. A token that the vocabulary
doesn't match is normalised by the table of first readings. All tokens of one
reading get one spelling, wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.expand import between, within
from corpusmill.llm.lookalikes import OTHERS, arcs, reading, skeleton, unseen_out
from corpusmill.sources.tables import cut, ship

#: Words in one part of the vocabulary. Words that letters drawn like several others may stand for are all used, in as many parts as they need; of the rest, which only choose the spelling of readings beyond ASCII, one part of the most frequent.
VOCABULARY = 1 << 16
#: Longest word in the last part of the vocabulary, in characters: bounds the trie.
LONGEST = 40
#: Rows, or different texts, of one group that meet in one join key; a larger group's pairs are all given too, from several.
ALL_PAIRS = 1000
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")


class Speller:
    """A trie of vocabulary words (with their counts) and the automaton over it. With ``only``, tokens are left as they stand unless they match and hold a letter drawn like several."""

    def __init__(self, words: list[tuple[str, int]], only: bool = False):
        self.root: dict = {}
        self.known: dict[str, str] = {}
        self.only = only
        for word, n in sorted(words, key=lambda x: (not x[0].isascii(), -x[1], x[0])):
            read = reading(word)
            if read.isascii():
                if OTHERS.keys() & set(word):
                    continue  # a word that is itself in doubt is no evidence of a spelling
                word = read
            node = self.root
            for unit in unicodedata.normalize("NFD", read):
                node = node.setdefault(unit, {})
            node.setdefault("", (word, n))  # the first word of a reading is its canonical spelling

    def match(self, token: str) -> str | None:
        """The vocabulary's spelling of a token at no cost, if there is one."""
        states = [(self.root, True)]
        for c in unicodedata.normalize("NFD", unseen_out(token)):  # unseen characters cost nothing
            after: dict[int, tuple[dict, bool]] = {}
            for node, first in states:
                for k, units in enumerate(arcs(c)):
                    child: dict | None = node
                    for unit in units:
                        child = child.get(unit)
                        if child is None:
                            break
                    if child is not None and not after.get(id(child), (0, False))[1]:
                        after[id(child)] = child, first and k == 0
            states = list(after.values())
            if not states:
                return None
        ends = [(*node[""], first) for node, first in states if "" in node]
        plain = [(not first, -n, word) for word, n, first in ends if word.isascii()]
        if plain:
            return min(plain)[2]
        return next((word for word, _, first in ends if first), None)

    def token(self, token: str) -> str:
        """The canonical spelling of a token."""
        have = self.known.get(token)
        if have is None:
            if self.only:
                have = OTHERS.keys() & set(token) and self.match(token) or token
            else:
                have = self.match(token) or reading(token)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = have
        return have

    def text(self, text: str) -> str:
        """The canonical form of a text; with ``only``, the text with the tokens that match."""
        plain = (lambda x: x) if self.only else reading
        if text.isascii():
            return plain(text)
        text, out, at = unseen_out(text), [], 0
        for m in _TOKEN.finditer(text):
            if not m[0].isascii():
                out += [plain(text[at : m.start()]), self.token(m[0])]
                at = m.end()
        return "".join([*out, plain(text[at:])])


_SPELLERS: dict[tuple, Speller] = {}


def speller(words: list[tuple[str, int]], only: bool = False) -> Speller:
    key = hash(tuple(words)), only
    if key not in _SPELLERS:
        if len(_SPELLERS) > 1:
            _SPELLERS.clear()
        _SPELLERS[key] = Speller(words, only)
    return _SPELLERS[key]


def odd_words(df: DataFrame, text: str) -> DataFrame:
    """``word``, ``n`` and ``skeleton`` of all words with a letter beyond ASCII, ``several`` where one of them is drawn like several others. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out():
            w = list(n)
            b = pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([skeleton(x) for x in w], pa.string()), pa.array([bool(OTHERS.keys() & set(x)) for x in w]), pa.array(list(n.values()), pa.int64())], ["word", "skeleton", "several", "n"])
            n.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    n.update(w for w in _TOKEN.findall(unseen_out(t)) if not w.isascii() and (len(w) <= LONGEST or OTHERS.keys() & set(w)))
            if len(n) > 200_000:
                yield out()
        yield out()

    return df.select(F.col(text)).mapInArrow(run, "word string, skeleton string, several boolean, n bigint").groupBy("word", "skeleton", "several").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text: str, size: int = VOCABULARY) -> list[list[tuple[str, int]]]:
    """The vocabulary in parts of about ``size`` words with their counts, the last one of the most frequent words beyond ASCII.

    The parts before it hold every word, in ASCII or not, that shares its
    skeleton with a token that has a letter drawn like several others; skeletons
    are dealt to parts whole. They are few: where there is none, there is no
    such part, and words in ASCII aren't counted at all. No more than about one
    part is collected at a time.
    """
    odd = cut(odd_words(df, text))
    asked = odd.where("several").select("skeleton").distinct()
    parts: list[list[tuple[str, int]]] = []
    if not asked.isEmpty():
        # counted before they are joined, so that each task's different words are all that is shuffled
        plain = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        plain = plain.withColumn("skeleton", F.translate("word", "Iv", "lu")).join(asked, "skeleton", "left_semi").select("word", "skeleton", "n")
        words = cut(plain.unionByName(odd.join(asked, "skeleton", "left_semi").select("word", "skeleton", "n")))
        of = -(-words.count() // size)
        for k in range(of):
            parts.append([(r.word, r.n) for r in words.where(F.pmod(F.xxhash64("skeleton"), F.lit(of)) == k).collect()])
    # the least count of which one part holds all words; counts up to 1,023 one by one, beyond by powers of two
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) * F.floor(F.log2("n") - 9))
    have = sorted(((r.step, r.least, r.words) for r in odd.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    least, total = None, 0
    for _, n, w in have:
        total += w
        if total > size:
            break
        least = n
    parts.append([] if least is None else [(r.word, r.n) for r in odd.where(F.col("n") >= least).select("word", "n").collect()])
    return parts


def canonical(df: DataFrame, key: str, text: str, hashes: bool = False, size: int = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` in canonical form; with ``hashes``, the 128-bit hashes ``form`` and ``raw`` instead.

    A null text stays null, an empty one empty, a blank one blank (its spaces
    made usual ones); with ``hashes`` rows without a visible character are left
    out, as they are no case. Line breaks, letter case, accents and digits stay.
    """
    ship(df.sparkSession)
    *several, words = vocabulary(df, text, size)
    kind = df.schema[key].dataType.simpleString()

    def some(part: list[tuple[str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            form = speller(part, only=True).text
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else form(t) for t in b.column(2).to_pylist()], pa.string())], ["__key", "__raw", "__text"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = speller(words).text
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else form(t) for t in b.column(2).to_pylist()], pa.string())], ["__key", "text"])

    def digest(s: str) -> bytes:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = speller(words).text
        for b in batches:
            keys, forms, raws = [], [], []
            for k, raw, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if t and (f := form(t)).strip():
                    keys.append(k)
                    raws.append(r := digest(raw))
                    forms.append(r if f == raw else digest(f))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], ["__key", "form", "raw"])

    src = df.select(F.col(key).alias("__key"), F.col(text).alias("__raw"), F.col(text).alias("__text"))
    for part in several:
        src = src.mapInArrow(some(part), f"__key {kind}, __raw string, __text string")
    out = src.mapInArrow(run_hashes, f"__key {kind}, form binary, raw binary") if hashes else src.mapInArrow(run, f"__key {kind}, text string")
    return out.withColumnRenamed("__key", key)


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Of every row with a visible text ``key``, ``class_id`` (the smallest key of the texts that read the same) and ``raw``, the hash of its text as stored: rows of one class and different ``raw`` are a pair of ``pairs``."""
    h = canonical(df, key, text, hashes=True).select("form", F.col(key).alias("k"), "raw").distinct()
    first = h.groupBy("form").agg(F.min("k").alias("class_id"))
    return h.join(first, "form").select(F.col("k").alias(key), "class_id", F.lower(F.hex("raw")).alias("raw"))


def pairs(df: DataFrame, key: str, text: str, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """``doc_a`` < ``doc_b``: all rows whose texts differ in characters but read the same.

    Equal texts are no pair. Different texts are paired by the hash of their
    form, and only then expanded to the rows that hold them; of both, not more
    than about ``all_pairs`` of one group meet in a join key, larger groups are
    dealt to several. Repeated rows count once; null keys are left out.
    """
    h = cut(canonical(df, key, text, hashes=True).select(F.col(key).alias("k"), "form", "raw").where("k IS NOT NULL").distinct())
    texts = h.select(F.col("form").alias("c"), F.col("raw").alias("k")).distinct()
    several = texts.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    links = cut(within(texts.join(several, "c", "left_semi"), all_pairs).select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    rows = h.select(F.col("raw").alias("c"), "k").join(links.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    # a row whose key is repeated with another text may pair with itself, or twice
    both = between(links, rows, all_pairs).where("ka != kb")
    return both.select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b")).distinct()
