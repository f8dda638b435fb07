"""Problem 5: records that are small alterations of one another.

Improved consistent weighted sampling over TF-IDF shingles: each text gets
``WEIGHTED`` samples, and two texts agree in one with a probability equal to
their weighted Jaccard similarity. Where what they share is frequent and what
differs is rare, that is far below the plain similarity; so each text has
``HASHES`` samples of its distinct shingles, all of one weight, beside them,
which agree by the plain one. Bands of three samples of a kind give candidate
pairs, and an exact count of the shingles decides on all of them: the weights
add candidates and drop none.

* Document frequencies come from a pass over all records into a count-min row
  of fixed size (``CELLS``): what is sent to the workers doesn't grow with the
  corpus.
* Copies are one class before anything is paired: a text that a third of the
  rows repeat is one row in the bands, and is expanded to its rows at the end,
  each with each up to ``ALL_PAIRS`` copies, beyond in proportion to the rows.
* A band bucket is never gathered: the join on band keys streams, and adaptive
  execution splits skewed ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.expand import between, to_rows, within
from corpusmill.sources.tables import cut, ship

SHINGLE = 5
CELLS = 1 << 18
#: Samples of each text: weighted ones, and behind them those of one weight.
WEIGHTED, HASHES = 16, 64
#: Each band joins three samples of a kind; every sample is in three bands.
BANDS = tuple((a + k, a + (k + 5) % n, a + (k + 17) % n) for a, n in ((0, WEIGHTED), (WEIGHTED, HASHES)) for k in range(n))
#: Bits of a band's key. Texts that share one by chance are candidates that the count drops; fewer bits are less to shuffle.
KEY = 48
#: Copies up to which a text's rows are paired each with each. Of more copies each is paired with the first, and of two linked texts with more than the square of it pairs of rows each row is paired with the other's first: ``groups`` names each row's class, so these pairs and the classes give all others, and no text loses a link.
ALL_PAIRS = 1000
#: Rows of one class that meet in one join key; larger classes are dealt to several.
PART = 1000
#: Classes that a task remembers at once, to send copies once.
SEEN = 1_000_000
#: Candidate texts up to which their keys are broadcast (8 bytes each), so that other texts aren't shuffled.
BROADCAST_KEYS = 1_000_000
_WORD = re.compile("[a-z0-9]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bits of the tables of quantiles; elements in a block of the sampling.
BITS, BLOCK = 14, 1 << 15
_SALT = [np.uint64(0x632BE59BD9B4E019 * (k + 1) >> 5 & (1 << 46) - 1) for k in range(WEIGHTED + HASHES)]
_ODD = [np.uint64(int.from_bytes(hashlib.blake2b(b"%d" % k, digest_size=8).digest(), "little") | 1) for k in range(WEIGHTED + HASHES)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """64-bit hash of each word, remembered in the worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


_WORDS = WordHashes()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct shingles of each text: row, hash of 46 bits, count. Sorted by row and hash."""
    get, flat, ends = _WORDS.__getitem__, [], []
    for t in texts:
        if t:
            flat.extend(map(get, _WORD.findall(t.lower())))
        ends.append(len(flat))
    w = np.array(flat, dtype=np.uint64)
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    h = w[:n].copy()
    for k in range(1, SHINGLE):
        h *= _M1
        h += w[k : n + k]
    h = _mix(h) >> np.uint64(18)
    h |= of[:n] << np.uint64(46)
    key = h[of[:n] == of[SHINGLE - 1 :]]  # a run of words that crosses into the next text is none
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    key, counts = key[first], np.diff(first, append=len(key))
    return (key >> np.uint64(46)).astype(np.int64), key & np.uint64((1 << 46) - 1), counts


def cell(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CELLS)).astype(np.int64)


def frequencies(df: DataFrame, text: str) -> np.ndarray:
    """Of each cell, how many records have a shingle there, over all records; last, the records counted."""
    size = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(CELLS, np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                row, h, _ = shingles(b.column(0).slice(at, 4000).to_pylist())
                n += np.bincount(cell(h), minlength=CELLS)
                docs += len(np.unique(row))
        for k in range(CELLS // size) if docs else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k * size : (k + 1) * size]], pa.list_(pa.int64()))], ["block", "n"])
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[docs]], pa.list_(pa.int64()))], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0) + n.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], ["block", "n"])

    out = np.zeros(CELLS + 1, np.int64)
    parts = df.select(F.col(text)).mapInArrow(count, "block int, n array<bigint>").repartition(8, "block")
    for r in parts.mapInArrow(add, "block int, n array<bigint>").toArrow().to_pylist():
        if r["block"] < 0:
            out[CELLS] = r["n"][0]
        else:
            out[r["block"] * size : (r["block"] + 1) * size] = r["n"]
    return out


def weights(freq: np.ndarray) -> np.ndarray:
    """The inverse document frequency of each cell, above 0."""
    return np.log1p((freq[CELLS] + 1.0) / (freq[:CELLS] + 0.5)).astype(np.float32)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at the middles of 2**BITS equal parts, and their logarithms, made positive."""
    q = (np.arange(1 << BITS) + 0.5) / (1 << BITS)
    lo, hi = np.zeros_like(q), np.full_like(q, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo.astype(np.float32), (np.log(lo) + 256).astype(np.float32)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a shingle, and for each its ``WEIGHTED`` and ``HASHES`` samples of 32 bits.

    For a weighted sample an element draws r, c ~ Gamma(2, 1) and b ~ U(0, 1)
    from its hash; t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r;
    the element of the least a is the sample, with its t. For one of the others
    it draws 64 bits; that of the least draw is the sample, named by the draw's
    lower half. Rows are taken in blocks that stay in the processor's cache, in
    buffers that are used again.
    """
    gamma, lngamma = _tables()
    first = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.empty((len(first), WEIGHTED + HASHES), np.uint32)
    lnw = np.log(weight, dtype=np.float32)
    ends = np.append(first, len(row))
    x = 0
    while x < len(first):
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + BLOCK, "right")) - 1)
        lo, hi = ends[x], ends[y]
        e, w, starts, n = h[lo:hi], lnw[lo:hi], first[x:y] - lo, hi - lo
        u, at, packed = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
        r, c, beta, t = (np.empty(n, np.float32) for _ in range(4))
        low, high = packed.view(np.uint32)[0::2], packed.view(np.float32)[1::2]
        for k in range(WEIGHTED + HASHES):
            np.bitwise_xor(e, _SALT[k], out=u)
            np.multiply(u, _ODD[k], out=u)
            if k >= WEIGHTED:
                out[x:y, k] = np.minimum.reduceat(u, starts) & np.uint64(0xFFFFFFFF)
                continue
            np.right_shift(u, np.uint64(64 - BITS), out=at)
            np.take(gamma, at.view(np.int64), out=r, mode="clip")
            np.right_shift(u, np.uint64(64 - 2 * BITS), out=at)
            np.bitwise_and(at, np.uint64((1 << BITS) - 1), out=at)
            np.take(lngamma, at.view(np.int64), out=c, mode="clip")
            np.right_shift(u, np.uint64(12), out=at)
            np.bitwise_and(at, np.uint64((1 << 24) - 1), out=at)
            np.copyto(beta, at.view(np.int64), casting="unsafe")
            beta *= np.float32(2**-24)
            np.divide(w, r, out=t)
            t += beta
            np.floor(t, out=t)
            np.subtract(beta, t, out=beta)
            beta -= np.float32(1)
            beta *= r  # - ln y - r
            np.add(c, beta, out=high)  # ln a, made positive by the table, so that its bits sort like its value
            np.bitwise_xor(u.view(np.uint32)[0::2], t.view(np.uint32), out=low)
            out[x:y, k] = np.minimum.reduceat(packed, starts).view(np.uint32)[0::2]
        x = y
    return row[first], out


def band_keys(s: np.ndarray) -> np.ndarray:
    """For each row a key of ``KEY`` bits of each band."""
    s = s.astype(np.uint64)
    return np.stack([_mix(_mix(_mix(s[:, i] + np.uint64(k << 33)) + s[:, j]) + s[:, m]) >> np.uint64(64 - KEY) for k, (i, j, m) in enumerate(BANDS)], 1).view(np.int64)


def classes(texts: list[str | None]) -> np.ndarray:
    """A key of 64 bits of each text as stored, 0 where there is no visible one. Of n different texts about n**2 / 2**65 pairs share a key."""
    digest = lambda t: int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1
    return np.array([digest(t) if t and not t.isspace() else 0 for t in texts], np.int64)


def once(c: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places of the classes, other than 0, that aren't in ``seen`` yet; they are added."""
    new = []
    for i, x in enumerate(c.tolist()):
        if x and x not in seen:
            seen.add(x)
            new.append(i)
    return np.array(new, np.int64)


class NearDuplicates:
    """Near duplicates of ``text`` among the rows of ``df``, named by the bigint ``key``.

    Null, empty and blank texts, and rows without a key, are no case. Of rows
    with one key and a text the one latest by ``at`` counts (without ``at``, or at
    equal times, the one of the largest class key). Equal texts are cases even when
    shorter than a shingle; else a text without a shingle is like no other.
    """

    def __init__(self, df: DataFrame, key: str, text: str, at: str | None = None, least: float = 0.5):
        ship(df.sparkSession)
        when = F.lit(0)
        if at:
            when = F.unix_micros(F.col(at).cast("timestamp")) if df.schema[at].dataType.typeName().startswith(("timestamp", "date")) else F.col(at)
        self.df = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.coalesce(when.cast("bigint"), F.lit(-(2**62))).alias("at")).where("k IS NOT NULL AND t IS NOT NULL AND t != ''")
        self.least = least

    def members(self) -> DataFrame:
        """Each key and the class of its text, cut from its lineage."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes(b.column(1).to_pylist())), b.column(2)], ["k", "c", "at"])

        keyed = self.df.mapInArrow(run, "k bigint, c bigint, at bigint")
        once = keyed.where("c != 0").groupBy("k", "at").agg(F.max("c").alias("c"))
        return cut(once.groupBy("k").agg(F.max_by("c", "at").alias("c")))

    def texts(self) -> DataFrame:
        """``c`` and ``t``: the different texts, up to copies that ``once`` drops; all rows of one class in one task.

        Each task drops the copies it sees before the shuffle, so a text that
        very many rows hold is sent once by each task.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                c = classes(b.column(0).to_pylist())
                new = once(c, seen)
                yield pa.RecordBatch.from_arrays([pa.array(c[new]), b.column(0).take(pa.array(new))], ["c", "t"])
                if len(seen) > SEEN:
                    seen.clear()

        return self.df.select("t").mapInArrow(run, "c bigint, t string").repartition("c")

    def candidates(self) -> DataFrame:
        """Pairs of classes, a < b, that share a band; each class is in a band once."""
        idf = weights(frequencies(self.df, "t"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                all_c = b.column(0).to_numpy()
                new = once(all_c, seen)
                for at in range(0, len(new), 4000):
                    part = new[at : at + 4000]
                    row, h, n = shingles(b.column(1).take(pa.array(part)).to_pylist())
                    rows, s = samples(row, h, idf[cell(h)] * n)
                    c = np.repeat(all_c[part][rows], len(BANDS))
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(s).ravel()), pa.array(c)], ["band", "c"])

        bands = self.texts().mapInArrow(run, "band bigint, c bigint")
        a, b = bands.alias("a"), bands.alias("b")
        return a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.c") < F.col("b.c"))).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()

    def links(self) -> DataFrame:
        """Pairs of classes, a < b, with their similarity, at least ``least``."""
        pairs = cut(self.candidates())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        few = pairs.count() <= BROADCAST_KEYS // 2

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(classes(b.column(0).to_pylist())), b.column(0)], ["c", "t"])

        texts = self.df.select("t").mapInArrow(keyed, "c bigint, t string")
        texts = texts.join(F.broadcast(ends) if few else ends, "c", "left_semi").groupBy("c").agg(F.min("t").alias("t"))
        both = pairs.join(texts.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b")
        least = self.least

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    (ra, ha, _), (rb, hb, _) = (shingles(part.column(k).to_pylist()) for k in (2, 3))
                    ka, kb = (ra.astype(np.uint64) << np.uint64(46)) | ha, (rb.astype(np.uint64) << np.uint64(46)) | hb
                    _, ia, _ = np.intersect1d(ka, kb, True, True)
                    sums = lambda r: np.bincount(r, minlength=part.num_rows)  # noqa: E731, B023
                    both = sums(ra[ia])
                    plain = both / np.maximum(sums(ra) + sums(rb) - both, 1)
                    keep = np.flatnonzero(plain >= least)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(plain[keep])], ["a", "b", "plain"])

        return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint, plain double")

    def pairs(self) -> DataFrame:
        """``rec_a`` < ``rec_b`` of each link and of copies; the number of pairs grows in proportion to the rows of a text beyond ``ALL_PAIRS``, not to their square."""
        members = self.members()
        sizes = cut(members.groupBy("c").agg(F.count("*").alias("n"), F.min("k").alias("first")))
        of = lambda x: sizes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"first_{x}"))
        links = cut(self.links().select("a", "b").join(of("a"), "a").join(of("b"), "b"))
        few = F.col("na") * F.col("nb") <= ALL_PAIRS**2
        both = between(links.where(few), members, PART)
        many = links.where(~few)
        both = both.unionByName(to_rows(many, members, ["a"], PART).select("ka", F.col("first_b").alias("kb")))
        both = both.unionByName(to_rows(many, members, ["b"], PART).where("kb != first_b").select(F.col("first_a").alias("ka"), "kb"))
        sized = members.join(sizes, "c")
        both = both.unionByName(within(sized.where(F.col("n").between(2, ALL_PAIRS)).select("c", "k"), PART))
        both = both.unionByName(sized.where((F.col("n") > ALL_PAIRS) & (F.col("k") != F.col("first"))).select(F.col("first").alias("ka"), F.col("k").alias("kb")))
        return both.select(F.least("ka", "kb").alias("rec_a"), F.greatest("ka", "kb").alias("rec_b"))

    def groups(self) -> DataFrame:
        """Every row that has a like one: its key, ``class_id`` (the smallest key of the rows with its text), ``group_id`` (that of its group) and ``links``, how many other texts it is linked to."""
        members = self.members()
        links = cut(self.links().select("a", "b"))
        roots = components(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
        first = members.groupBy("c").agg(F.min("k").alias("class_id"))
        of = members.join(first, "c").join(roots, "c", "left").join(degree, "c", "left").withColumn("root", F.coalesce("root", "c"))
        size = of.groupBy("root").agg(F.count("*").alias("n"), F.min("k").alias("group_id")).where("n > 1")
        return of.join(size, "root").select(F.col("k").alias("rec_id"), "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """``c`` and ``root``, the least node it is connected with, of every node of ``links`` (a, b).

    Large-star and small-star rounds until nothing changes: each round is two
    joins on the edges, whose number doesn't grow, and its result is cut into
    the shared folder. A node with very many neighbours is aggregated in
    parts before its shuffle.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("x")).select("u", F.least("u", "x").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("c"), "root").union(edges.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct())
