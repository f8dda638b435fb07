"""Problem 2: question and answer pairs whose answer is none.

A multi-label linear classifier on hashed n-grams of the answer and features of
the pair (its end, its overlap with the question, its language beside the
question's, its last word beside the context's words). It is trained on a
bounded sample: real pairs as sound ones, and copies of them made defective
(emptied, truncated, refused, copied from the question, swapped into another
language). Real pairs that a first model takes for defective are left out of
the second's sound ones. Each label's threshold is calibrated on held-out
pairs.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import ship

LABELS = ("empty_answer", "truncated_answer", "refusal", "copied_question", "other_language")
#: Pairs in the training sample at most, those of the smallest hashes of their id.
SAMPLE = 5000
#: Hashed features; epochs and first step of the training.
WIDTH, EPOCHS, STEP = 1 << 17, 6, 0.5
#: Quarters of the features (n-grams, the end, form and overlap, language) and the labels that use each.
PARTS = np.repeat(np.array([[1, 0, 1, 0, 0], [0, 1, 0, 0, 0], [1, 1, 1, 1, 0], [0, 0, 0, 0, 1]], np.float32), WIDTH // 4, axis=0)
#: Scores from which a real pair is no example of a sound one, of one model after the other; the first has no n-grams.
DOUBTS = 1.0, 1.0, 0.3

# What stands for a missing answer.
STAND_INS = ["", " ", "-", "--", ".", "...", "?", "()", "[]", "n/a", "N/A", "NA", "none", "None", "null", "nil", "TBD", "tbd", "(none)", "[none]", "[no answer]", "no answer", "(blank)", "[blank]", "unknown", "not available", "to be determined", "to follow", "see above", "\u200b", "\xa0", "_", "*", "#"]
# Ways to decline or to claim that no answer can be given, with what may stand before and after.
OPENERS = ["", "", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "Regrettably ", "As an AI assistant, ", "As a language model, ", "I apologize, but ", "Unfortunately - ", "I'm afraid ", "Apologies, "]
REFUSALS = [
    "the provided context does not say", "the context does not say", "the passage does not say", "not stated in the context", "not mentioned in the passage", "I don't know", "I do not know", "I am unable to answer this question", "I'm unable to answer that", "I cannot answer this question", "I can't help with that request", "I can't answer that",
    "I cannot say anything about {x}", "that cannot be determined from what was given", "this cannot be determined from the text", "it is impossible to say from the passage", "I must decline to respond to this", "I have to decline", "I do not have access to that information", "I don't have that information", "there is not enough information to answer",
    "there is insufficient information to answer", "I won't be able to assist here", "I won't answer this", "this is not something I can give legal advice on", "I am not able to provide legal advice", "no answer can be given", "the text provides no information about {x}", "the passage gives no information on this", "I have no information about {x}", "the question cannot be answered", "it is not possible to answer from the context",
    "the text gives no details about {x}", "the document is silent on {x}", "nothing in the passage answers this", "details about {x} are not provided", "that information is not given here", "I can't say", "I cannot comment on {x}", "there is no mention of {x} in the text", "I'm not able to discuss {x}", "the record does not contain this information",
]
CLOSERS = ["", "", "", "", " Let me know if you need something else.", " You may wish to contact {x} directly.", " Please consult a lawyer.", " Please consult a qualified attorney.", " I suggest asking an expert.", " Is there anything else I can help with?", " Please provide more details.", " Contact {x} for details.", " You could ask {x} instead."]
# The commonest short words of some languages, without accents.
FUNCTION_WORDS = {
    "en": "paid once published called copies signed the of and to was not by for no had is in that on before after because an as with from or this they who it its has have be were which when what how why did does between under until unless days rest paid their be at",
    "es": "cuanto cuando quien cual donde por que el la los las de del y que en un una se no por con para su al lo como mas despues antes aunque sin tras fue fueron porque segun esta ano pago",
    "fr": "combien quand quel quelle comment pourquoi versa verse le la les de des du et que qui en un une se ne pas pour avec sur au aux par dans est ete avait ont selon apres avant sans dont cette son a deux parce",
    "de": "wie viel wann wer wo warum welche welcher zahlte jahr der die das den dem des und nicht ein eine einen einem einer zu von mit im in am auf fur ist war wurde hatte nach weil aber sich an bei aus uber zwischen teil",
    "pt": "quanto quando quem qual onde por o os as do da dos das e que em um uma se nao por com para seu ao no na como mais depois antes foi porque segundo esta ano pagou",
    "it": "quanto quando chi quale dove il lo gli le di del della dei e che in un una si non per con su al come piu dopo prima nel nella fu ha perche secondo questo anno sono",
    "nl": "de het een en van niet in op te dat die voor met is was werd aan door omdat na maar bij naar om zijn uit over",
    "pl": "na nie do sie o po od za przez ze jest byl ktory oraz dla jak co ale przed",
    "sv": "och att det som en ett pa av for med den inte om till var hade efter men fran eller",
}
FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
SCRIPTS = (("cyrillic", "\u0400", "\u052f"), ("greek", "\u0370", "\u03ff"), ("arabic", "\u0600", "\u06ff"), ("hebrew", "\u0590", "\u05ff"), ("cjk", "\u3040", "\u9fff"), ("hangul", "\uac00", "\ud7af"), ("devanagari", "\u0900", "\u097f"))
_DECLINES = [x for x in {unicodedata.normalize("NFKC", r.split("{x}")[0].strip().lower()) for r in REFUSALS} if len(x) > 8]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|\S")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”")
_DOTS = re.compile(r"\s*(?:…|\.\.\.|\[\.\.\.\]|\[…\])[.?!]*$")
_LAST = re.compile(r"[$\w][\w.,'’-]*$")


def plain(text: str) -> str:
    """Lower case, without accents and unseen characters."""
    return text.lower() if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c) not in ("Mn", "Cf"))


def languages(text: str) -> Counter:
    """Evidence of each language: its function words, or letters of its script. Quoted titles are no evidence beside other words."""
    rest = _QUOTED.sub(" ", text)
    text = rest if len(_LETTERS.findall(rest)) > 2 else text
    out: Counter = Counter()
    for w in _LETTERS.findall(plain(text)):
        if not w.isascii():
            for name, a, b in SCRIPTS:
                out[name] += a <= w[0] <= b
        for name, words in FUNCTION_WORDS.items():
            out[name] += w in words
    return out


def shape(token: str, first: bool) -> str:
    if token[0].isdigit():
        return "#"
    if token[0].isupper() and not first and token[1:].islower():
        return "Xx"
    return plain(token)


def features(question: str | None, answer: str | None, context: str | None, known: frozenset[str]) -> list[int]:
    """Indices of the pair's features; ``known`` are words common in answers."""
    q, a = question or "", answer or ""
    bare = "".join(c for c in a if unicodedata.category(c) != "Cf").strip() if not a.isascii() else a.strip()
    dots = bool(_DOTS.search(bare)) and len(bare) > 6
    if dots:
        bare = _DOTS.sub("", bare)
    rest = _QUOTED.sub(" qq ", bare)  # a quoted title among other words is one token, whatever its language
    tokens = _WORD.findall(rest if len(_LETTERS.findall(rest)) > 2 else bare)
    out, end, form, tongue = [], [], ["bias"], ["bias"]
    form += [f"letters{min(3, len(_LETTERS.findall(bare)))}", f"tokens{min(8, len(tokens))}"]
    ends = bare[-1:]
    stop = ends in (".", "!", "?") and not bare.endswith(("..", ". ."))
    shapes = [shape(t, k == 0) for k, t in enumerate(tokens)]
    body = shapes[:-1] if stop and len(shapes) > 1 else shapes
    marked = ["<s>", *body, "</s>"]
    for n in (1, 2, 3):
        out += ["w" + " ".join(marked[k : k + n]) for k in range(len(marked) - n + 1)]
    end += [f"{stop}" + " ".join(marked[-k:]) for k in (2, 3, 4, 5)] + [" ".join(marked[:3]) + "|" + " ".join(marked[-k:]) for k in (2, 3)]
    form += ["stop" if stop else "nostop"] * 3
    form += ["endchar" + (ends if not ends.isalnum() else "a"), "whole" + plain(bare) if len(bare) < 16 else "long"]
    # the end
    if dots:
        form += ["ellipsis"] * 3
    if bare.count("(") != bare.count(")") or bare.count('"') % 2 or bare.count("[") != bare.count("]"):
        form += ["unbalanced"] * 3
    last = _LAST.search(bare)
    if not stop and last and len(bare) > 3:
        w = last[0].rstrip(".,")
        have = set(re.findall(r"[$\w][\w.,'’-]*[\w]|[$\w]", context or "")) | set(re.findall(r"\w+", context or ""))
        word = plain(w)
        inside = w in have or word in known
        cut = not inside and (any(x.startswith(w) for x in have) or any(x.startswith(word) for x in known))
        form += ["lastcut" if cut else "lastin" if inside else "lastout"] * 2
    low = plain(rest)
    if any(x in low for x in _DECLINES):
        form += ["declines"] * 3
    # the question
    qw, aw = re.findall(r"\w+", plain(q)), re.findall(r"\w+", plain(bare))
    qs = Counter(qw)
    rest = [w for w in aw if w not in qs]
    over = sum(1 for w in set(qw) if w in set(aw)) / max(1, len(qs))
    form += [f"rest{min(6, len(rest))}", f"over{int(over * 5)}", f"rest{min(6, len(rest))}over{int(over * 5)}"]
    if len(aw) > 2 and over > 0.7 and len(rest) <= 4:
        whole = " ".join(qw) in " ".join(aw)
        form += [f"{'holds' if whole else 'nears'}question{len(rest)}"] * 3
    # the language
    ql, al = languages(q), languages(bare)
    of = max(ql, key=lambda k: (ql[k], k), default=None)
    if of and ql[of] and al:
        other = max((al[k] for k in al if k != of), default=0)
        lead = other - al[of]
        if other:
            tongue += ["lead" + str(max(-3, min(4, lead)))] * 3
            if lead > 0 and not al[of]:
                tongue += ["foreign" + str(min(4, other))] * 3
    quarter = WIDTH // 4
    return [k * quarter + (crc32(f.encode()) & (quarter - 1)) for k, part in enumerate((out, end, form, tongue)) for f in part]


class Defects:
    """Makes pairs defective."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def empty(self) -> str:
        return self.r.choice(STAND_INS)

    def truncated(self, answer: str) -> str | None:
        """Cut inside a word or behind one, now and then with dots or an open bracket."""
        r, a = self.r, answer.strip().rstrip(".")
        words = a.split()
        if len(words) < 4:
            return None
        if r.random() < 0.5:
            at = r.randrange(2, len(words))
            cut = " ".join(words[:at])
        else:
            at = r.randrange(len(a) // 5, len(a) - 1)
            cut = a[:at].rstrip()
            if not (cut[-1:].isalnum() and a[len(cut) : len(cut) + 1].isalnum()):
                return None
        x = r.random()
        if x < 0.12 and " " in cut:
            head, _, tail = cut.rpartition(" ")
            cut = f"{head} ({tail}"
        elif x < 0.35:
            cut = cut.rstrip(",;") + r.choice(["…", "...", " [...]", " ..."])
        return cut

    def refused(self, name: str) -> str:
        r = self.r
        text = r.choice(OPENERS) + r.choice(REFUSALS) + r.choice([".", ".", ".", ""]) + r.choice(CLOSERS)
        text = text.replace("{x}", name)
        return r.choice([text[:1].upper() + text[1:], text, text.upper() if r.random() < 0.1 else text])

    def copied(self, question: str) -> str:
        r, q = self.r, question.strip()
        drop = r.randrange(max(1, len(q.split())))
        return r.choice([q, q, f"  {q} \n", q.rstrip("?"), q.upper(), q.lower(), f'"{q}"', f"{q} {q}", f"{q.rstrip('?')}...?", f"{q.rstrip('?')}…", " ".join(w for k, w in enumerate(q.split()) if k != drop), q.replace(",", ""), f"Q: {q}", f"Question: {q}", f"You asked: {q}", f"Answer: {q.rstrip('?')}", f"The question is: {q.rstrip('?')}.", f"You want to know: {q}"])

    def foreign(self, names: list[str], not_of: str | None, real: list[tuple[str, str]]) -> str:
        """A sentence of another language: a real one swapped in, or function words between the pair's names."""
        r = self.r
        mine = [t for k, t in real if k != not_of]
        if mine and r.random() < 0.4:
            return r.choice(mine)
        k = r.choice([x for x in (*FUNCTION_WORDS, "cyrillic", "greek") if x != not_of])
        if k in ("cyrillic", "greek"):
            a = [chr(c) for c in (range(0x430, 0x450) if k == "cyrillic" else range(0x3B1, 0x3CA))]
            words = ["".join(r.choice(a) for _ in range(r.randint(1, 9))) for _ in range(r.randint(4, 12))]
        else:
            pool = sorted(FUNCTION_WORDS[k])
            syllables = [w[:2] for w in pool if len(w) > 2]
            words = [r.choice(pool) if r.random() < 0.5 else "".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(r.randint(5, 14))]
        for n in names[:2]:
            words.insert(r.randrange(len(words)), n)
        s = " ".join(words)
        return s[:1].upper() + s[1:] + "."


class Model:
    """Weights, thresholds and the words common in answers."""

    def __init__(self, known: frozenset[str]):
        self.known = known
        self.w = np.zeros((WIDTH, len(LABELS)), np.float32)
        self.at = np.zeros(len(LABELS), np.float32)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(LABELS)), np.float32)
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        starts = np.cumsum([0, *map(len, rows[:-1])])
        return np.add.reduceat(self.w[flat], starts, axis=0)

    def fit(self, rows: list[list[int]], y: np.ndarray, seed: int = 0, parts: np.ndarray = PARTS) -> None:
        """Logistic regression of each label, by adaptive steps on small batches."""
        rng, seen = np.random.default_rng(seed), np.full_like(self.w, 1e-6)
        flat = np.fromiter((i for r in rows for i in r), np.int32)
        lens = np.array([len(r) for r in rows], np.int64)
        starts = np.cumsum(lens) - lens
        for epoch in range(EPOCHS):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 64):
                part = order[k : k + 64]
                n = lens[part]
                first = np.cumsum(n) - n
                f = flat[np.arange(n.sum()) + np.repeat(starts[part] - first, n)]
                s = np.add.reduceat(self.w[f], first, axis=0)
                g = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[part]) / len(part)).astype(np.float32)
                by = np.argsort(f, kind="stable")
                f = f[by]
                edges = np.flatnonzero(np.diff(f, prepend=-1))
                at = f[edges]
                grad = np.add.reduceat(np.repeat(g, n, axis=0)[by], edges, axis=0)
                w = self.w[at]
                grad = (grad + 1e-6 * w) * parts[at]
                seen[at] += grad**2
                self.w[at] = w - STEP / (1 + epoch) * grad / np.sqrt(seen[at])

    def calibrate(self, rows: list[list[int]], y: np.ndarray) -> None:
        """For each label the threshold in the middle of the widest best range of F1 on held-out pairs; without such pairs nothing passes."""
        if not rows:
            self.at[:] = np.inf
            return
        s = self.scores(rows)
        for k in range(len(LABELS)):
            order = np.argsort(-s[:, k])
            hit = np.cumsum(y[order, k])
            f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, y[:, k].sum()))
            best = np.flatnonzero(f1 >= f1.max() - 1e-9)
            lo = s[order[min(best[-1] + 1, len(order) - 1)], k] if len(order) > 1 else s[order[0], k]
            self.at[k] = (s[order[best[0]], k] + lo) / 2

    def defect(self, s: np.ndarray, unanswerable: np.ndarray) -> np.ndarray:
        """The label of the largest margin above its threshold, else -1."""
        margin = s - self.at
        margin[unanswerable, LABELS.index("refusal")] = -np.inf
        best = margin.argmax(1)
        return np.where(margin[np.arange(len(s)), best] > 0, best, -1) if len(s) else best


def train(rows: list[tuple], seed: int = 7) -> Model:
    """The model of a sample of (type, question, answer, context)."""
    rows = [r for r in rows if r[1]]
    count = Counter(w for r in rows for w in set(re.findall(r"\w+", plain(r[2] or ""))))
    model = Model(frozenset(w for w, n in count.items() if n >= max(3, len(rows) // 1000)))
    make = Defects(seed)
    tongue = [max(ls, key=lambda k: (ls[k], k)) if (ls := languages(r[1])) and max(ls.values()) else None for r in rows]
    sample_tongue = Counter(t for t in tongue if t).most_common(1)
    usual = sample_tongue[0][0] if sample_tongue else None
    real = [(t, r[2]) for t, r in zip(tongue, rows) if r[2] and t and t != usual and (a := languages(r[2])) and max(a, key=lambda k: (a[k], k)) == t]
    english = [(usual, r[2]) for t, r in zip(tongue, rows) if r[2] and t == usual and len(r[2]) > 40][:500]
    sound, bad, of, cut_of = [], [], [], []
    for row, (r, t) in enumerate(zip(rows, tongue)):
        kind, q, a, c = r
        if kind == "unanswerable" and a and a.strip():  # its refusal is right, but one
            bad.append((2, q, a, c))
        else:
            sound.append((q, a, c))
        if kind != "unanswerable" and a and len(a) > 20 and a.rstrip().endswith("."):  # complete without its full stop
            sound.append((q, a.rstrip().rstrip("."), c))
        if c and (short := re.findall(r"\b(?:[A-Z]\w{4,}(?: [A-Z]\w+)?|\d+ [A-Z][a-z]+ \d{4}|[\d.]+ percent|\$[\d.,]*\d(?: million)?)\b", c)) and make.r.random() < 0.25:  # an answer may be short
            sound.append((q, make.r.choice(short), c))
        thing = " ".join(q.rstrip(" ?").split()[-2:])
        name = thing if make.r.random() < 0.3 else next(iter(re.findall(r"[A-Z]\w+ ?(?:[A-Z]\w+)?", q[1:])), "this").strip()
        bad.append((0, q, make.empty(), c))
        for _ in range(2):
            if a and kind != "unanswerable" and (x := make.truncated(a)):
                bad.append((1, q, x, c))
        bad += [(2, q, make.refused(name), c), (2, q, make.refused(name), c)]
        bad.append((3, q, make.copied(q), c))
        bad.append((4, q, make.foreign(re.findall(r"(?<!^)[A-Z]\w+", q), t, real + (english if t and t != usual else [])), c))
        of += [row] * (len(sound) - len(of))
        cut_of += [row] * (len(bad) - len(cut_of))
    f = [features(*x, model.known) for x in sound]
    g = [features(*x[1:], model.known) for x in bad]
    labels = np.zeros((len(f) + len(g), len(LABELS)), np.float32)
    labels[np.arange(len(f), len(f) + len(g)), [x[0] for x in bad]] = 1
    held = np.random.default_rng(seed).random(len(labels)) < 0.2
    everything = f + g
    use = np.ones(len(labels), bool)
    for turn, doubt in enumerate(DOUBTS):
        model.w[:] = 0
        at = np.flatnonzero(use & ~held)
        parts = PARTS.copy()
        if turn == 0:
            parts[: WIDTH // 2] = 0
        model.fit([everything[i] for i in at], labels[at], seed, parts)
        use[: len(f)] = (model.scores(f) < doubt).all(1)  # real pairs that look defective are no examples of sound ones
        doubtful = {of[k] for k in np.flatnonzero(~use[: len(f)])}
        use[len(f) :] = [x[0] != 1 or i not in doubtful for x, i in zip(bad, cut_of)]  # nor is what was cut from them
    at = np.flatnonzero(use & held)
    model.calibrate([everything[i] for i in at], labels[at])
    return model


def defects(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``id`` and ``defect`` of each defective pair.

    ``df``: id, type, question, answer, context; other columns are ignored. A
    null, empty or blank answer is ``empty_answer``; a null question or context
    only takes away the features made of it; a null type isn't unanswerable.
    Rows with a null id are left out; repeated rows count once, and of rows
    with one id and different defects each defect is given. An empty table, or
    one without questions, gives what the rules for empty answers give.
    """
    ship(df.sparkSession)
    df = df.select("id", "type", "question", "answer", "context").where("id IS NOT NULL")
    ids = df.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)  # chosen by id alone, so no context is shuffled
    some = df.join(F.broadcast(ids), "id", "left_semi").select("id", "type", "question", "answer", "context").collect()
    once = {r.id: tuple(r)[1:] for r in sorted(some, key=lambda r: tuple(x or "" for x in r))}
    model = train(list(once.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            s = model.scores([features(q, a, c, model.known) for q, a, c in zip(d["question"], d["answer"], d["context"])])
            of = model.defect(s, np.array([t == "unanswerable" for t in d["type"]], bool))
            bare = [not "".join(c for c in a or "" if unicodedata.category(c) != "Cf").strip() for a in d["answer"]]
            hits = [(i, LABELS[0 if e else k]) for i, k, e in zip(d["id"], of, bare) if e or k >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string())], ["id", "defect"])

    return df.mapInArrow(run, "id string, defect string").distinct()
