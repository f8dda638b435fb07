"""Problem 3: continuous text from records of scanned pages, and what noise they had.

The corpus itself gives the knowledge: how often each word occurs, which words
stand beside plain numbers, and which short lines stand in the middle of
sentences (running titles) rather than between paragraphs (headings). With it,
each record is read in three steps: lines and pieces of the page frame are
taken out; the remaining stream of characters is decoded into words by a joint
segmentation that may join pieces, part words whose blank was lost, drop
hyphens and undo misread characters, each at its cost, against the cost of the
words themselves; paragraph boundaries are chosen by dynamic programming over
the lines.
"""

from __future__ import annotations

import hashlib
import math
import mmap
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut, ship

#: Times that a line's shape must stand inside a sentence, over all different texts, to be a running title's; other titles' numbers don't count.
TITLES = 3
#: Shapes of short lines that occur ``TITLES`` times (rarer ones tell nothing) up to which they are sent to the workers; if there are more, all are looked up in a sorted file instead. (Words need no such bound: no more than 1 / SURE_CAP of them can be sure.)
SHAPES = 1 << 17
#: Longest line, in characters, that is taken for a printed line; longer ones are collapsed text, with pieces of the frame inside.
PRINTED = 110
#: Hashes of texts that a task remembers at once on reading, to send copies once; one forgotten is found behind the shuffle.
SEEN = 1_000_000
#: Share of all words, each text counted once, from which a word in lower case, or one that begins with a capital, is surely one.
SURE_LOW, SURE_CAP = 2e-5, 3e-6
#: Share of a word's places from which it is not rare beside a plain number.
RARE = 0.002
#: Costs, in nats: an unknown word and each of its letters; a blank inside a word; a hyphen at a line's end; a misread letter, sign or case.
UNKNOWN, LETTER, BLANK, HYPHEN, MISREAD, SIGN = 17.0, 0.4, 5.0, 1.0, 4.0, 2.0
#: Cost of a blank lost between words; most of a word of two letters that may stand first in one ("thereof" is no such case).
LOST, SHORT = 6.0, 6.5
#: Pieces of one word at most; most that its misread characters may cost.
PIECES, BUDGET = 4, 8.5

#: Misread characters from which a record has this noise whatever they are.
EVIDENCE = 2
#: What a single one must save over the chunks as they stand, in nats, where it is no sign inside a word and nothing else shows a scan; below, it is as likely a rare word or a typing error.
MARGIN = 7.0

# Letters as scanners misread them: what is read, and what was printed.
LETTERS = "c:e e:c b:h h:b cl:d rn:m m:rn ii:u u:ii vv:w w:vv m:in ri:n n:ri n:u u:n q:g g:q v:y y:v f:t t:f l:i i:l li:h tl:d o:c c:o I:l l:I rri:m in:m a:o o:a s:a lc:k e:o t:r r:t j:i"
SIGNS = "@:a ¢:c †:t |:l |:i |:I 0:o 0:O 1:l 1:i 1:I 5:s 5:S 6:b 8:B 8:g 9:g 3:e 4:A 7:T €:e £:E $:s §:s ®:R !:l !:i ß:B ¡:i 2:z +:t (:c µ:u"
SMALL = frozenset("of the to in on for and or a an v vs as at by with from et al re no".split())
STRAY = "•|;'~^*_°`¦·,.:!\"¨´"
HYPHENS = "-‐‑\xac\xad"
_SUB = [(*x.split(":"), MISREAD, "letter") for x in LETTERS.split()] + [(x[: x.index(":", 1)], x[x.index(":", 1) + 1 :], SIGN, "sign") for x in SIGNS.split()]
_BY: dict[str, list] = {}
for _r in _SUB:
    _BY.setdefault(_r[0][0], []).append(_r)
_EDGE = ".,;:()\"'?!$%[]{}“”‘’«»—–/*"
_NUMBER = re.compile(r"[\d.,:/]*\d[\d.,:/()\-]*(?:[A-Za-z]{1,2}|st|nd|rd|th)?\)?(?:-[A-Z]{1,2})?")
_ENDS = re.compile(r"[.!?:]['\"”’)\]]*$")
# Forms of a printed page's number, alone on its line or inside collapsed text.
_PAGE = r"\[\*\d{1,5}\]|[-—–] ?\d{1,5} ?[-—–]|[Pp]\. ?\d{1,5}|Page \d{1,5}(?: of \d{1,5})?|\d{1,5} ?/ ?\d{1,5}|\d{1,5} \||\| \d{1,5}"
_PAGE_LINE = re.compile(rf"(?:{_PAGE}|\d{{1,5}})")
_PAGE_INLINE = re.compile(r"(?<!\S)(?:\[\*\d{1,5}\]|[-—–] \d{1,5} [-—–]|[Pp]\. \d{1,5}|Page \d{1,5} of \d{1,5}|\d{1,5} / \d{1,5}|\d{1,5} \||\| \d{1,5})(?!\S)")
_MARKS = ("[*", "Page ", " / ", " |", "| ", "p. ", "P. ", "- ", "— ", "– ")
_WITH_PAGE = re.compile(r"(?:(\d{1,5})\s{2,})?(\S.*?\S)(?:\s{2,}(\d{1,5}))?")


def core(chunk: str) -> tuple[str, str, str]:
    """The word in a chunk between blanks, with the marks before and behind it."""
    a = chunk.lstrip(_EDGE)
    b = a.rstrip(_EDGE)
    return chunk[: len(chunk) - len(a)], b, a[len(b) :]


def framed(shape: str, mid: int, rest: int) -> bool:
    """Whether a shape is a running title's: it stands inside sentences, and is more than names and numbers."""
    return mid >= TITLES and mid >= 0.6 * (mid + rest) and len(k := shape.split()) > 2 and not set(k) <= {"X", "#", "of", "and"}


def damaged(frame: str) -> list[str]:
    """The patterns of a running title in capitals with one damaged word; none of another title."""
    k = frame.split()
    return [" ".join((*k[:i], "*", *k[i + 1 :])) for i in range(len(k))] if all(y == "v" or y[0] in "A^#" for y in k) else []


class Shelf:
    """Shapes with their counts, the first two places of frames and the patterns of damaged ones in one sorted file.

    Every worker has the file and maps it, so that only the pages looked up are
    in memory. An entry is "=" and a shape, "<" and a beginning, or "*" and a
    pattern; none holds a tab or a line's end, as chunks have no white space.
    """

    def __init__(self, name: str):
        self.name, self.map, self.have = name, None, {}

    def __reduce__(self) -> tuple:
        return Shelf, (self.name,)

    @staticmethod
    def filled(seen: DataFrame) -> Shelf:
        """A file of all rows of ``seen`` (shape, mid, rest); the driver has one partition of it at a time."""

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for x, mid, rest in zip(*(b.column(i).to_pylist() for i in range(3))):
                    rows.append(("=" + x, mid, rest))
                    if framed(x, mid, rest):
                        rows += [("<" + " ".join(x.split()[:2]), 0, 0), *(("*" + y, 0, 0) for y in damaged(x))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], ["key", "mid", "rest"])

        every = seen.select("shape", "mid", "rest").mapInArrow(entries, "key string, mid bigint, rest bigint").groupBy("key").agg(F.max("mid").alias("mid"), F.max("rest").alias("rest"))
        name = f"shapes-{uuid.uuid4().hex[:12]}"
        path = f"{tempfile.mkdtemp(prefix='corpusmill-')}/{name}"
        with open(path, "wb") as f:
            for r in every.orderBy("key").toLocalIterator():
                f.write(f"{r.key}\t{r.mid}\t{r.rest}\n".encode())
        seen.sparkSession.sparkContext.addFile(path)
        return Shelf(name)

    def get(self, key: str) -> tuple[int, int] | None:
        if key not in self.have:
            if len(self.have) > 400_000:
                self.have.clear()
            self.have[key] = self._find(key.encode())
        return self.have[key]

    def _find(self, key: bytes) -> tuple[int, int] | None:
        if self.map is None:
            with open(SparkFiles.get(self.name), "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        lo, hi = 0, len(self.map)
        while lo < hi:  # both are beginnings of lines
            at = self.map.rfind(b"\n", lo, (lo + hi) // 2) + 1 or lo
            end = self.map.find(b"\n", at)
            have, mid, rest = self.map[at:end].split(b"\t")
            if have == key:
                return int(mid), int(rest)
            lo, hi = (end + 1, hi) if have < key else (lo, at)
        return None


class Shelved:
    """One kind of a shelf's entries, in the place of a set or dict."""

    def __init__(self, shelf: Shelf, mark: str):
        self.shelf, self.mark = shelf, mark

    def get(self, shape: str, default: tuple[int, int]) -> tuple[int, int]:
        return self.shelf.get(self.mark + shape) or default

    def __contains__(self, key: str | tuple[str, ...]) -> bool:
        return self.shelf.get(self.mark + (key if isinstance(key, str) else " ".join(key))) is not None


class ShelvedFrames(Shelved):
    def __contains__(self, shape: str) -> bool:
        return framed(shape, *self.get(shape, (0, 0)))


class Lexicon:
    """What the corpus knows of its words."""

    def __init__(self, words: dict[str, int], total: int, before: dict[str, int], behind: dict[str, int], shapes: dict[str, tuple[int, int]]):
        self.n, self.total = words, max(total, 1)
        self.low, self.cap = max(5, SURE_LOW * total), max(3, SURE_CAP * total)
        self.before, self.behind = before, behind
        self.kinds: dict[str, str] = {}
        self.learn_shapes(shapes)
        self.known: dict[str, bool] = {}
        self.fixed: dict[str, tuple] = {}
        self.parted: dict[str, tuple] = {}
        self.trie: dict = {}

    def known_word(self, w: str) -> bool:
        n = self.n.get
        if n(w, 0) >= (self.low if w.islower() else self.cap):
            return True
        low = w.lower()
        if w[:1].isupper() and (w[1:].islower() or w.isupper()) and (n(low, 0) >= self.low or n(low.capitalize(), 0) >= self.cap):
            return True
        return False

    def fine(self, chunk: str) -> bool:
        """Whether a chunk needs no reading: sure words, numbers, marks; words in capitals or of swapped case; their compounds."""
        have = self.known.get(chunk)
        if have is None:
            if len(self.known) > 400_000:
                self.known.clear()
            have = self.known[chunk] = self._fine(core(chunk)[1])
        return have

    def _fine(self, w: str) -> bool:
        if not w or self.known_word(w) or _NUMBER.fullmatch(w):
            return True
        if w[-1] in HYPHENS:
            return self.n.get(w, 0) >= self.low
        if len(w) > 1 and w.isalpha() and (w.isupper() or self.known_word(w.swapcase())):
            return True
        for mark in ("-", "'s", "’s", "—", "/"):
            if mark in w and w.replace("'", "").replace("’", "").replace("-", "").isalnum() and all(not x or self.known_word(x) or _NUMBER.fullmatch(x) for x in w.split(mark)):
                return True
        return not any(c.isalpha() for c in w) and not any(c in HYPHENS for c in w)

    def cost(self, w: str) -> float | None:
        """The cost of a sure word, else None."""
        if not self.known_word(w):
            return None
        n = max(self.n.get(w, 0), self.n.get(w.lower(), 0) / 20, self.n.get(w.lower().capitalize(), 0) / 20)
        return -math.log(max(n, 1) / self.total)

    def correct(self, w: str) -> tuple[str, float, tuple[str, ...]] | None:
        """The cheapest sure word that ``w`` may be a misreading of, its cost and what was misread."""
        if w not in self.fixed:
            if len(self.fixed) > 200_000:
                self.fixed.clear()
            self.fixed[w] = self._correct(w)
        return self.fixed[w]

    def _trie(self) -> dict:
        if not self.trie:
            for w in self.n:
                if len(w) > 2 and w.isalpha() and not (w.isupper()) and self.known_word(w):
                    node = self.trie
                    for c in w:
                        node = node.setdefault(c, {})
                    node[""] = w
        return self.trie

    def _correct(self, w: str) -> tuple[str, float, tuple[str, ...]] | None:
        """A walk through the trie of sure words along ``w``; each misread character adds its cost, up to ``BUDGET``."""
        if len(w) < 3 or len(w) > 40 or w.isupper():
            return None
        if any(self.known_word(w[:i] + w[i + 1] + w[i] + w[i + 2 :]) for i in range(len(w) - 1)):
            return None  # two letters swapped: a typing error
        best, last = None, len(w) - 1
        stack: list[tuple] = [(0, self._trie(), 0.0, ())]
        while stack:
            i, node, c, how = stack.pop()
            if i > last:
                if "" in node and how and (k := self.cost(node[""])) is not None and (best is None or c + k < best[1]):
                    best = (node[""], c + k, how)
                continue
            ch = w[i]
            if (child := node.get(ch)) is not None:
                stack.append((i + 1, child, c, how))
            if i and ch.isupper() and (child := node.get(ch.lower())) is not None:
                stack.append((i + 1, child, c + (0.5 if "case" in how else SIGN), (*how, "case")))
            if c + SIGN > BUDGET:
                continue
            if ch in STRAY and 0 < i < last:
                stack.append((i + 1, node, c + SIGN, (*how, "sign")))
            for read, real, k, kind in _BY.get(ch, ()):
                if c + k <= BUDGET and w.startswith(read, i):
                    child = node
                    for x in real:
                        child = child.get(x)
                        if child is None:
                            break
                    else:
                        stack.append((i + len(read), child, c + k, (*how, kind)))
        return best

    def split(self, w: str) -> tuple[str, float] | None:
        """The cheapest reading of ``w`` as sure words with the blanks between them lost, and its cost.

        Only of words in lower case (but for the first letter) that the corpus
        doesn't have more often: names and rare words stay whole.
        """
        if w not in self.parted:
            if len(self.parted) > 200_000:
                self.parted.clear()
            self.parted[w] = self._split(w)
        return self.parted[w]

    def _split(self, w: str) -> tuple[str, float] | None:
        m = len(w)
        if not 5 <= m <= 40 or not w.isalpha() or not w[1:].islower() or self.n.get(w, 0) > 2:
            return None
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * m
        for j in range(2, m + 1):
            for i in range(max(0, j - 24), j - 1):
                if best[i][0] < math.inf and (j - i < m) and (i or w[:j].islower() or w[:j].lower() in SMALL):
                    k = self.cost(w[i:j])
                    if k is not None and (j - i > 2 or i == 0 and k <= SHORT) and best[i][0] + k + LOST < best[j][0]:
                        best[j] = best[i][0] + k + LOST, i
        if best[m][0] == math.inf:
            return None
        words, j = [], m
        while j:
            words.append(w[best[j][1] : j])
            j = best[j][1]
        return " ".join(words[::-1]), best[m][0] - LOST

    def decode(self, chunks: list[str]) -> list[tuple[int, int, str, tuple[str, ...], float]]:
        """The cheapest reading of a run of chunks: from, to, text, what was wrong ("hyphen", "blank", "letter", "sign", "case", "lost") and what it saves over the chunks as they stand."""
        parts = [core(c) for c in chunks]
        m = len(chunks)
        best: list[tuple] = [(0.0, 0, "", ())] + [(math.inf, 0, "", ())] * m
        for i in range(m):
            at = best[i][0]
            lead, w, trail = parts[i]
            options = [(i + 1, self._as_is(w), chunks[i], ())]
            if not self._fine(w):
                fix = self.correct(w)
                if fix:
                    options.append((i + 1, fix[1], lead + fix[0] + trail, fix[2]))
                if cuts := self.split(w):
                    options.append((i + 1, cuts[1], lead + cuts[0] + trail, ("lost",)))
            joined, how, extra = w, (), 0.0
            for j in range(i + 1, min(m, i + PIECES)):
                if parts[j - 1][2] or parts[j][0] or not joined or not parts[j][1]:
                    break
                if joined[-1] in HYPHENS:
                    joined, extra, how = joined[:-1] + parts[j][1], extra + HYPHEN, (*how, "hyphen")
                else:
                    joined, extra, how = joined + parts[j][1], extra + BLANK, (*how, "blank")
                text = lambda w: lead + w + parts[j][2]  # noqa: E731, B023
                k = self.cost(joined)
                if k is not None:
                    options.append((j + 1, k + extra, text(joined), how))
                else:
                    if fix := self.correct(joined):
                        options.append((j + 1, fix[1] + extra, text(fix[0]), (*how, *fix[2])))
                    if set(how) == {"hyphen"} and joined.isalpha() and len(joined) > 3 and not self._fine(w) and not self.known_word(parts[j][1]):
                        options.append((j + 1, UNKNOWN + LETTER * len(joined) + extra, text(joined), how))
                    if how == ("hyphen",) and chunks[i][-1] == "-" and self._fine(kept := w + parts[j][1]):  # the hyphen is the word's own
                        options.append((j + 1, self._as_is(kept) + extra, text(kept), ()))
            for j, k, text, how in options:
                if at + k < best[j][0]:
                    best[j] = (at + k, i, text, how)
        out, j = [], m
        while j:
            _, i, text, how = best[j]
            saved = sum(self._as_is(w) for _, w, _ in parts[i:j]) - (best[j][0] - best[i][0]) if how else 0.0
            out.append((i, j, text, how, saved))
            j = i
        return out[::-1]

    def _as_is(self, w: str) -> float:
        if not w or _NUMBER.fullmatch(w):
            return 8.0
        k = self.cost(w)
        if k is None and w[-1] in HYPHENS and self.n.get(w, 0) >= self.low:
            k = -math.log(self.n[w] / self.total)
        if k is None and "-" in w.strip(HYPHENS) and self._fine(w):
            k = 12.0
        return UNKNOWN + LETTER * len(w) if k is None else k

    def learn_shapes(self, shapes: dict[str, tuple[int, int]] | Shelf) -> None:
        """Shapes of running titles, in memory or on a shelf."""
        if isinstance(shapes, Shelf):
            self.shapes, self.frames = Shelved(shapes, "="), ShelvedFrames(shapes, "=")
            self.starts, self.capital_frames = Shelved(shapes, "<"), Shelved(shapes, "*")
            return
        self.shapes = shapes
        self.frames = {x for x, (mid, rest) in shapes.items() if framed(x, mid, rest)}
        self.starts = {tuple(x.split()[:2]) for x in self.frames}
        self.capital_frames = {y for x in self.frames for y in damaged(x)}

    def capital_frame(self, kinds: list[str]) -> bool:
        """Whether the shape is a known running title's in capitals, but for one damaged word."""
        return any(" ".join((*kinds[:i], "*", *kinds[i + 1 :])) in self.capital_frames for i in range(len(kinds)))

    def kind(self, chunk: str) -> str:
        """The chunk's place in a line's shape."""
        have = self.kinds.get(chunk)
        if have is None:
            if len(self.kinds) > 400_000:
                self.kinds.clear()
            have = self.kinds[chunk] = self._kind(chunk)
        return have

    def _kind(self, chunk: str) -> str:
        w = core(chunk)[1]
        if not w or w in "-—–|":
            return ""
        if any(c.isdigit() for c in w) and not any(c.isalpha() for c in w.replace("st", "").replace("th", "")):
            return "#"
        low = w.lower()
        if w[0].isupper():
            return "^" + low if self.n.get(low, 0) >= self.low else "A" if w.isupper() and len(w) > 1 else "X"
        return low if self.n.get(low, 0) >= self.low or len(low) < 3 else "x"

    def shape(self, chunks: list[str]) -> str:
        return " ".join(k for c in chunks if (k := self.kind(c)))

    def title_share(self, shape: str) -> float | None:
        """How often lines of this shape stand in the middle of a sentence; None where too few are known."""
        mid, rest = self.shapes.get(shape, (0, 0))
        return mid / (mid + rest) if mid + rest >= TITLES else None

    def stray_number(self, chunk: str, prev: str | None, after: str | None) -> int:
        """On how many sides, of two, a plain number doesn't belong beside its neighbour."""
        if not chunk.isdigit() or len(chunk) > 4:
            return 0

        def stray(of: dict[str, int], c: str | None, ends: bool) -> bool:
            if c is None or ends and _ENDS.search(c):
                return True
            w = core(c)[1]
            return of.get(w, 0) < RARE * self.n.get(w, 0) if self.known_word(w) else not any(x.isalnum() for x in w)

        return stray(self.before, prev, True) + stray(self.behind, after, False)


def titled(chunks: list[str]) -> bool:
    """Whether a short line could be a title: capitals and numbers, joined by small words only."""
    if not 1 <= len(chunks) <= 12:
        return False
    words = [w for c in chunks if (w := core(c)[1])]
    return bool(words) and all(not w[0].islower() or w in SMALL or len(w) < 3 for w in words) and any(c.isalpha() for c in words[0] + words[-1] + words[len(words) // 2]) and not chunks[-1].endswith((",", ";", "."))


def loose(lines: list[str], k: int) -> bool:
    """Whether the next line's first word would still have fitted on line ``k``: no wrapped line ends so inside a paragraph."""
    nxt = next((x for x in lines[k + 1 :] if x), "")
    width = max((len(x) for i, x in enumerate(lines[max(0, k - 4) : k + 5], max(0, k - 4)) if i != k), default=0)
    return not nxt or len(lines[k]) + 1 + len(nxt.split(" ", 1)[0]) <= width


def breaks_in(prev: str | None, nxt: str | None) -> bool:
    """Whether a sentence runs from ``prev`` on to ``nxt``."""
    return bool(prev and nxt) and not _ENDS.search(prev) and (nxt[0].islower() or not _ENDS.search(prev + "x") and not prev.endswith((";", ",")) or nxt[0].islower())


def short_lines(text: str) -> Iterator[tuple[list[str], bool]]:
    """The loose title-like lines of a text, and whether each stands inside a sentence."""
    lines = [x.strip() for x in text.split("\n")]
    for k, line in enumerate(lines):
        if not line or len(line) > 100 or _PAGE_LINE.fullmatch(line):
            continue
        title = _WITH_PAGE.fullmatch(line)[2] if len(line) > 1 else line
        chunks = title.split()
        if titled(chunks) and loose(lines, k):
            body = lambda xs: next((x for x in xs if x and not _PAGE_LINE.fullmatch(x) and len(x) > 30), None)
            yield chunks, breaks_in(body(lines[k - 1 :: -1] if k else []), body(lines[k + 1 :]))


class Record:
    """One record on its way to clean text."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.lex, self.noise = lexicon, set()
        lines = [x.strip() for x in text.split("\n")]
        self.pages: list[int] = []  # numbers surely of pages
        self.doubtful: list[tuple[list[str], int]] = []  # numbers that fit on one side only, and where they stand
        kept = self.frame_lines(lines) if sum(1 for x in lines if x) > 1 else [(x, False) for x in lines]
        self.lines = [(self.frame_inline(x) if len(x) > PRINTED else x.split(), head) for x, head in kept]
        self.settle()
        self.decode()

    def frame_lines(self, lines: list[str]) -> list[tuple[str, bool]]:
        """The lines without those of the page frame; with each, whether it is a heading."""
        lex, n = self.lex, len(lines)
        role = [""] * n
        titles: dict[int, list[str]] = {}
        for k, line in enumerate(lines):
            if not line or len(line) > PRINTED:
                continue
            if _PAGE_LINE.fullmatch(line):
                role[k] = "page"
                self.pages += [int(x) for x in re.findall(r"\d+", line)[:1]]
                continue
            m = _WITH_PAGE.fullmatch(line)
            title, numbered = (m[2], bool(m[1] or m[3])) if m else (line, False)
            chunks = title.split()
            if titled(chunks) and (numbered or loose(lines, k) or lex.shape(chunks) in lex.frames):
                titles[k] = chunks
                role[k] = "numbered" if numbered else "title"
        body = lambda ks: next((lines[i] for i in ks if lines[i] and not role[i]), None)
        shapes = Counter(lex.shape(c) for c in titles.values())
        for k, chunks in titles.items():
            share = lex.title_share(shape := lex.shape(chunks))
            inside = breaks_in(body(range(k - 1, -1, -1)), body(range(k + 1, n)))
            header = role[k] == "numbered" or (inside and (share is None or share > 0.2)) or (share is not None and share >= 0.5) or (share is None and shapes[shape] > 1)
            if header:
                self.noise.add("header")
                if role[k] == "numbered":
                    self.noise.add("page_number")
                role[k] = "frame"
            elif len(chunks) < 10 and share is not None and share < 0.2:
                role[k] = "heading"
            else:
                role[k] = ""
        if "page" in role:
            self.noise.add("page_number")
        return [(x, r == "heading") for x, r in zip(lines, role) if r not in ("page", "frame")]

    def frame_inline(self, line: str) -> list[str]:
        """The chunks of a long line without pieces of the page frame inside it."""
        lex = self.lex
        if any(x in line for x in _MARKS) and (at := _PAGE_INLINE.findall(line)):
            self.pages += [int(re.search(r"\d+", x)[0]) for x in at]
            line = _PAGE_INLINE.sub(" ", line)
            self.noise.add("page_number")
        chunks = line.split()
        n = len(chunks)
        drop: set[int] = set()
        k = -1
        for at in [i for i, c in enumerate(chunks) if c[0].isupper() or c[0].isdigit()]:
            if at < k:
                continue
            c, nxt = chunks[at], chunks[at + 1] if at + 1 < n else ""
            end = 0
            if c.isdigit() or (c.isupper() and len(c) > 1):
                if nxt.isupper() and len(nxt) > 1 or (nxt == "v." and at + 2 < n and chunks[at + 2].isupper()):
                    run = self.capitals_at(chunks, at)
                    kinds = lex.shape(chunks[at:run]).split()
                    if lex.capital_frame(kinds) or lex.capital_frame(kinds[1:]) or lex.capital_frame(kinds[:-1]):
                        end = run
                    elif self.capitals_outside(chunks) <= 7 and (prev := chunks[at - 1] if at else "a")[0].islower() and not _ENDS.search(prev) and (run == n or not chunks[run][0].isupper()) and not _ENDS.search(chunks[run - 1]):
                        end = run
                    else:
                        k = run  # a sentence in capitals
            if not end and at >= k and (lex.kind(c), lex.kind(nxt)) in lex.starts:
                end = self.title_at(chunks, at)
            if end:
                self.noise.add("header")
                first, last = at, end
                prev, after = chunks[at - 1] if at else None, chunks[end] if end < n else None
                inner = lex.shape(chunks[at:end])
                if c.isdigit() and " ".join(inner.split()[1:]) in lex.frames and inner not in lex.frames:
                    self.noise.add("page_number")
                elif chunks[end - 1].isdigit() and " ".join(inner.split()[:-1]) in lex.frames and inner not in lex.frames:
                    self.noise.add("page_number")
                elif after and lex.stray_number(after, prev, chunks[end + 1] if end + 1 < n else None) == 2:
                    self.noise.add("page_number")
                    last = end + 1
                elif prev and at - 1 not in drop and lex.stray_number(prev.lstrip("\0"), chunks[at - 2] if at > 1 else None, after) == 2:
                    self.noise.add("page_number")
                    first = at - 1
                drop.update(range(first, last))
                k = last
            elif sides := lex.stray_number(c, chunks[at - 1] if at else None, nxt or None):
                if sides == 2:
                    self.noise.add("page_number")
                    self.pages.append(int(c))
                    drop.add(at)
                else:
                    chunks[at] = c = "\0" + c
                    self.doubtful.append((chunks, at))
        if drop:
            kept = [c for i, c in enumerate(chunks) if i not in drop]
            self.doubtful = [(kept, kept.index(x[i])) if x is chunks else (x, i) for x, i in self.doubtful if x is not chunks or i not in drop]
            return kept
        return chunks

    def settle(self) -> None:
        """Doubtful numbers are of pages where they continue sure page numbers, or the record has running titles."""
        gone = []
        for chunks, at in self.doubtful:
            chunks[at] = chunks[at].lstrip("\0")
            citing = at and chunks[at - 1].endswith(".") and len(chunks[at - 1]) < 6  # "App. 12"
            if not citing and ("header" in self.noise or any(0 < abs(int(chunks[at]) - x) <= 4 for x in self.pages)):
                gone.append((chunks, at))
        for chunks, at in sorted(gone, key=lambda x: -x[1]):
            self.noise.add("page_number")
            del chunks[at]

    def capitals_outside(self, chunks: list[str]) -> int:
        """Words in capitals that are in no known running title."""
        n, k = 0, 0
        while k < len(chunks):
            run = self.capitals_at(chunks, k) if chunks[k].isupper() else 0
            if run:
                kinds = self.lex.shape(chunks[k:run]).split()
                n += 0 if self.lex.capital_frame(kinds) or self.lex.capital_frame(kinds[1:]) or self.lex.capital_frame(kinds[:-1]) else sum(c.isupper() for c in chunks[k:run])
            k = max(k + 1, run)
        return n

    @staticmethod
    def capitals_at(chunks: list[str], k: int) -> int:
        """The end of a run of words in capitals that begins at chunk ``k``, else 0."""
        end, capital = k, 0
        while end < len(chunks):
            c = chunks[end]
            if c.isupper() and len(c) > 1:
                capital += 1
            elif not (c == "v." or c.isdigit() or not any(x.isalnum() for x in c)):
                break
            end += 1
        while end > k and not any(x.isalnum() for x in chunks[end - 1]):
            end -= 1
        return end if capital >= 2 else 0

    def title_at(self, chunks: list[str], k: int) -> int:
        """The end of the longest running title of a known shape that begins at chunk ``k``, else 0."""
        lex, kinds, best = self.lex, [], 0
        for end in range(k, min(len(chunks), k + 12)):
            if x := lex.kind(chunks[end]):
                kinds.append(x)
            if len(kinds) > 2 and " ".join(kinds) in lex.frames:
                best = end + 1
        if best and best - k < 5:
            prev, nxt = chunks[k - 1] if k else None, chunks[best] if best < len(chunks) else None
            if prev and nxt and not nxt[0].isupper() and prev[0].islower() and lex.kind(prev) in SMALL and chunks[k][0].isupper() and lex.kind(chunks[k]) == "X":
                return 0  # a name behind a preposition, inside a sentence
        return best

    def decode(self) -> None:
        """Words by joint segmentation, over the runs of chunks around those that aren't sure."""
        lex = self.lex
        stream = [(c, k) for k, (chunks, _) in enumerate(self.lines) for c in chunks]
        known, fine = lex.known, lex.fine
        odd = [i for i, (c, _) in enumerate(stream) if not (known[c] if c in known else fine(c))]
        self.found: Counter = Counter()
        if not odd:
            return
        near = sorted({j for i in odd for j in range(max(0, i - 2), min(len(stream), i + 3))})
        runs: list[list[int]] = []
        for j in near:
            if runs and runs[-1][1] == j:
                runs[-1][1] = j + 1
            else:
                runs.append([j, j + 1])
        out: list[list[str]] = [[] for _ in self.lines]
        at = 0
        for a, b in runs:
            for c, k in stream[at:a]:
                out[k].append(c)
            for i, _, text, how, saved in lex.decode([c for c, _ in stream[a:b]]):
                out[stream[a + i][1]].append(text)
                self.found.update(set(how))
                if set(how) - {"hyphen", "lost"}:  # a lost blank is repaired, but is no noise inside a word
                    self.found["misread"] += 1
                    self.found["sure"] += "sign" in how or saved >= MARGIN
            at = b
        for c, k in stream[at:]:
            out[k].append(c)
        self.lines = [(o, head) for o, (_, head) in zip(out, self.lines)]
        if self.found["hyphen"]:
            self.noise.add("hyphen")
        if self.found["misread"] >= EVIDENCE or self.found["misread"] and (self.found["sure"] or self.noise or self.wrapped()):
            self.noise.add("glyph")

    def wrapped(self) -> bool:
        """Whether lines are broken inside sentences, as on a page."""
        lines = [c for c, _ in self.lines if c]
        return sum(not _ENDS.search(a[-1]) and b[0][0].islower() for a, b in zip(lines, lines[1:])) > 1

    def text(self) -> str:
        """The lines joined to paragraphs.

        Dynamic programming over the lines: a boundary costs by how the line
        above ends (inside a sentence, or full to the width), joining costs by
        what speaks for a boundary (a blank line, a heading, a short last line
        behind a sentence's end), and a line alone that ends no sentence costs
        extra.
        """
        lines = [(" ".join(c), head) for c, head in self.lines]
        width = max((len(x) for x, _ in lines), default=0)
        blocks: list[tuple[str, bool, bool]] = []
        blank = False
        for x, head in lines:
            if x:
                blocks.append((x, head, blank))
                blank = False
            else:
                blank = True
        if not blocks:
            return ""
        # two states at each boundary, joined or broken; behind each its cheapest cost and the choices that led there
        best, back = (0.0, 0.0), []
        for k, ((a, ah, _), (b, bh, gap)) in enumerate(zip(blocks, blocks[1:])):
            ends = bool(_ENDS.search(a))
            short = len(a) + 1 + len(b.split(" ", 1)[0]) <= 0.9 * width or width > 140
            broken = (0.5 if ends else 4.0) + (0.0 if short or ah or bh else 2.0) + (3.0 if b[0].islower() and not ah else 0.0)
            joined = (3.0 if gap else 0.0) + (9.0 if ah or bh else 0.0) + (3.0 if ends and short else 0.0) + (9.0 if width > 140 else 0.0)
            alone = 0.0 if k == 0 or ah or ends else 2.0  # a line between two boundaries that ends no sentence
            came = (int(best[1] < best[0]), int(best[1] + alone < best[0]))
            back.append(came)
            best = best[came[0]] + joined, best[came[1]] + (alone if came[1] else 0.0) + broken
        cuts, state = [], int(best[1] < best[0])
        for k in range(len(back) - 1, -1, -1):
            if state:
                cuts.append(k + 1)
            state = back[k][state]
        edges = [0, *reversed(cuts), len(blocks)]
        return "\n".join(" ".join(x for x, _, _ in blocks[i:j]) for i, j in zip(edges, edges[1:]))


def distinct(texts: DataFrame, text: str) -> DataFrame:
    """``h`` and ``t``: the different texts, once each up to those that the reading task drops by ``h``, and all rows of one ``h`` in one task.

    Each task drops the copies it sees before the shuffle, so a text that very many rows hold is sent once by each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hs, ts = [], []
            for t in b.column(0).to_pylist():
                if t and not t.isspace():
                    h = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    if h not in seen:
                        seen.add(h)
                        hs.append(h)
                        ts.append(t)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ts, pa.string())], ["h", "t"])

    return texts.select(F.col(text)).mapInArrow(run, "h bigint, t string").repartition("h")


def learn(texts: DataFrame, text: str) -> Lexicon:
    """The corpus' knowledge, from all different texts. Tasks count first; only counts are shuffled, and only of frequent words, and of shapes up to ``SHAPES``, collected.

    A text counts once however many rows hold it: copies of a damaged one would
    make its own misread words and broken pieces sure words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"kind": pa.array([k[0] for k in n], pa.string()), "key": pa.array([k[1:] for k in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})
            n.clear()
            return b

        for b in batches:
            raw: Counter = Counter()
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h in seen:
                    continue
                seen.add(h)
                c = t.split()
                raw.update(c)
                for i in [i for i, x in enumerate(c) if x.isdigit() and len(x) <= 4]:
                    if i:
                        n["b" + core(c[i - 1])[1]] += 1
                    if i + 1 < len(c):
                        n["a" + core(c[i + 1])[1]] += 1
                if t.count("\n") > 2:
                    for chunks, mid in short_lines(t):
                        n[("m" if mid else "r") + " ".join(chunks)] += 1
            for c, k in raw.items():
                w = core(c)[1]
                if w and len(w) <= 40 and not w.isdigit():
                    n["w" + w] += k
                n["t"] += k
            if len(n) > 200_000:
                yield out()
        yield out()

    counts = distinct(texts, text).mapInArrow(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts)  # read several times below
    total = counts.where("kind = 't'").agg(F.sum("n")).first()[0] or 0
    # no more than 1 / SURE_CAP words are this frequent; beside numbers only those count that aren't rare there
    words = counts.where((F.col("kind") == "w") & (F.col("n") >= max(3, SURE_CAP * total))).select("key", "n")
    beside = counts.where("kind IN ('a', 'b')").join(words.withColumnRenamed("n", "all"), "key").where(F.col("n") >= RARE * F.col("all")).select("kind", "key", "n")
    got = words.select(F.lit("w").alias("kind"), "key", "n").unionByName(beside).collect()
    of = lambda k: {r.key: r.n for r in got if r.kind == k}
    lexicon = Lexicon(of("w"), total, of("b"), of("a"), {})

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for kind, line, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                n[lexicon.shape(line.split()), kind == "m"] += k
            yield pa.RecordBatch.from_pydict({"shape": pa.array([k[0] for k in n], pa.string()), "mid": pa.array([v if k[1] else 0 for k, v in n.items()], pa.int64()), "rest": pa.array([0 if k[1] else v for k, v in n.items()], pa.int64())})

    seen = counts.where("kind IN ('m', 'r')").mapInArrow(shapes, "shape string, mid bigint, rest bigint").groupBy("shape").agg(F.sum("mid").alias("mid"), F.sum("rest").alias("rest"))
    seen = cut(seen.where(F.col("mid") + F.col("rest") >= TITLES))
    lexicon.learn_shapes(Shelf.filled(seen) if seen.count() > SHAPES else {r["shape"]: (r.mid, r.rest) for r in seen.collect()})
    return lexicon


def cleaned(texts: DataFrame, with_text: bool = True) -> DataFrame:
    """rec_table, rec_id, text (clean) and noise (its kinds, sorted) of each row of ``texts`` (rec_table, rec_id, text).

    Null and blank texts stay as they are, without noise; rows with a null id
    are left out. Without ``with_text`` the text is null. Repeated rows stay repeated. Very long texts are read whole.
    An empty table gives an empty result.
    """
    ship(texts.sparkSession)
    texts = texts.select("rec_table", "rec_id", "text").where("rec_id IS NOT NULL")
    lexicon = learn(texts, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out, noise = [], []
                for t in part.column(2).to_pylist():
                    if not t or t.isspace():
                        out.append(t)
                        noise.append([])
                        continue
                    r = Record(t, lexicon)
                    out.append(r.text() if with_text else None)
                    noise.append(sorted(r.noise))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(noise, pa.list_(pa.string()))], ["rec_table", "rec_id", "text", "noise"])

    return texts.mapInArrow(run, "rec_table string, rec_id string, text string, noise array<string>")


def found(texts: DataFrame) -> DataFrame:
    """rec_table, rec_id, noise: each kind of noise of each record; repeated rows count once."""
    return cleaned(texts, with_text=False).where(F.size("noise") > 0).select("rec_table", "rec_id", F.explode("noise").alias("noise")).distinct()
