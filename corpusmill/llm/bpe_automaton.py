"""Problem 6: encode a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a deterministic automaton whose paths are exactly
the correct tokenisations. Its construction is the successive merge gadget:
start from one state with a loop for each byte; the gadget of a merge
``a b -> c`` splits the state that ``a`` leads to, deletes the arc ``b`` from
the split state, and adds an arc ``c`` beside each arc ``a``, leading to a copy
of the state that ``b`` leads to. All arcs of one label lead to one state, so a
state is named by the token read last, and a gadget is kept factored, as three
facts about ``c``: its out-arcs are copied from those of ``b`` at that moment,
its in-arcs from those of ``a``, and the arc ``(a, b)`` is gone from then on.
Written out, the table would have a cell for each pair of tokens (2.5e9 of
them); rows are unfolded where the corpus walks, then kept.

Encoding walks the automaton along the bytes of a pre-split word, longest arc
first. The accepting path of a word is unique, hence a position that failed
once fails always and the walk is linear in the word's length. Decoding emits
the arc labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import ship

#: Where the public vocabulary files are; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: White space by Unicode's White_Space property, as the pre-splitting rule of the vocabulary counts it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The vocabulary's own pre-splitting rule (fixed pattern).
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same rule for texts of ASCII only.
SPLIT_ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words kept in a worker's memory of finished words; beyond it the memory is emptied, which changes no result.
WORDS_KEPT = 400_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of one vocabulary: ``ids`` by byte string, ``merges`` in order."""

    def __init__(self, ids: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        self.ids = ids
        self.label = {i: b for b, i in ids.items()}
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.born = {i: -1 for i in self.bytes}  # when the token's gadget ran; bytes are there from the start
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gone: dict[tuple[int, int], int] = {}  # when an arc was deleted
        for at, (a, b) in enumerate(merges):
            self._gadget(at, ids[a], ids[b], ids[a + b])
        self.longest = max(len(b) for b in ids)
        self.next: dict[int, bool] = {}
        prefixes = {b[:k] for b, i in ids.items() if i in self.born for k in range(1, len(b) + 1)}
        self.trie = {p: (i if (i := ids.get(p)) in self.born else None) for p in prefixes}

    def _gadget(self, at: int, a: int, b: int, c: int) -> None:
        self.gone.setdefault((a, b), at)
        if c not in self.born:
            self.born[c], self.left[c], self.right[c] = at, a, b

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after ``state`` has an out-arc ``token``; unfolded once, then looked up."""
        key = state << 20 | token
        known = self.next.get(key)
        if known is None:
            known = self.next[key] = self._unfold(state, token)
        return known

    def _unfold(self, p: int, t: int) -> bool:
        born, gone, before = self.born, self.gone, NEVER
        while True:
            if gone.get((p, t), NEVER) < before:
                return False
            if born[p] < 0 and born[t] < 0:
                return True
            if born[p] >= born[t]:  # p's out-arcs were copied from its right part, before arcs deleted by the same gadget
                before, p = min(before, born[p]), self.right[p]
            else:  # arcs t were added beside those of its left part; the leftmost of two equal merges came first
                before, t = min(before, born[t] + 1), self.left[t]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the unique accepting path of ``word``."""
        n = len(word)
        if not n:
            return ()
        trie, arc, dead = self.trie, self.arc, set()
        path: list[int] = []
        ends: list[int] = [0]
        choices: list[list[tuple[int, int]]] = []

        def options(at: int) -> list[tuple[int, int]]:
            found, p = [], (path[-1] if path else None)
            for k in range(1, min(self.longest, n - at) + 1):
                piece = word[at : at + k]
                if piece not in trie:
                    break
                t = trie[piece]
                if t is not None and at + k not in dead and (p is None or arc(p, t)):
                    found.append((t, at + k))
            return found

        choices.append(options(0))
        while ends[-1] < n:
            if choices[-1]:
                t, end = choices[-1].pop()
                if end in dead:
                    continue
                path.append(t)
                ends.append(end)
                choices.append(options(end))
            else:
                dead.add(ends[-1])
                choices.pop()
                ends.pop()
                path.pop()
        return tuple(path)

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose path has these labels."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


def load(path: str) -> TokenAutomaton:
    """The automaton of a ``tokenizers`` file of kind byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_letters()
    raw = lambda s: bytes(of[c] for c in s)
    ids = {raw(s): i for s, i in model["vocab"].items() if all(c in of for c in s)}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return TokenAutomaton(ids, ((raw(a), raw(b)) for a, b in pairs))


class Words(dict):
    """Finished words of a worker; a missing one is encoded by the automaton."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        return ids


_LOADED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(load(path))
    return _LOADED[path]


def encode_texts(texts: Iterable[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the texts, one behind the other."""
    import regex

    wide, narrow, words = regex.compile(SPLIT), re.compile(SPLIT_ASCII), words_of(path)
    get, ids, offsets = words.__getitem__, [], [0]
    for t in texts:
        if t:
            ids.extend(chain.from_iterable(map(get, (narrow if t.isascii() else wide).findall(t))))
        offsets.append(len(ids))
    return np.array(offsets, dtype=np.int32), np.array(ids, dtype=np.int32)


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids array<int>`` of every row's text, as stored, without special tokens.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text; blank texts are encoded as they stand. Repeated
    rows stay repeated, extra columns are dropped, a null key stays null. No
    shuffle: one pass over the two columns.
    """
    ship(df.sparkSession)
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):  # bounds the lists of one step
                part = b.slice(at, 2000)
                offsets, ids = encode_texts(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["__key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, ids array<int>")
    return out.withColumnRenamed("__key", key)


def decode(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``text`` whose ids these are: the emitted arc labels. A null list gives a null text."""
    ship(df.sparkSession)
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = words_of(path).automaton.decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else emit(x) for x in b.column(1).to_pylist()], pa.string())], ["__key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("__key"), F.col(ids).alias("__ids")).mapInArrow(run, f"__key {kind}, text string").withColumnRenamed("__key", key)
