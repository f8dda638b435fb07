"""Exact and near duplicates, contamination, and the report of each document's fate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources.tables import cut

PERMUTATIONS, BANDS, ROWS = 32, 3, 10


def same_text(c: Column) -> Column:
    """Key of equal normal forms."""
    return F.sha2(T.normalize(T.text_of(c)), 256)


def first_of(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group, by the smallest ``order``; combined before the shuffle, so that a hot group is one row for each task."""
    keys = {f"_k{i}": c for i, c in enumerate(by)}
    row = F.struct(*(df[c] for c in df.columns))
    return df.withColumns(keys).groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def gram_set(df: DataFrame, text: str, n: int = 13) -> DataFrame:
    """The distinct n-grams of held-out texts (column ``gram``)."""
    return df.select(F.explode(T.grams(T.words(T.text_of(F.col(text))), n)).alias("gram")).distinct()


def holding(df: DataFrame, key: str, text: str, held: DataFrame, n: int = 13, bound: int = 2_000_000) -> DataFrame:
    """Keys of rows with at least one n-gram of ``held`` (column ``gram``).

    Grams are made distinct in the row before they are looked up; ``held`` is
    broadcast only when its counted size is within ``bound`` grams.
    """
    grams = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(T.grams(T.words(T.text_of(F.col(text))), n))).alias("gram"))
    few = held.limit(bound + 1).count() <= bound
    return grams.join(F.broadcast(held) if few else held, "gram", "left_semi").select(F.col("k").alias(key)).distinct()


def shingle_sets(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """``k`` and ``s``, the distinct shingles as hashes of 64 bits; one row for each normal form, that of the smallest key."""
    w = T.words(T.text_of(F.col(text)))
    rows = df.select(F.col(key).alias("k"), F.array_join(w, " ").alias("t")).where("t != ''").groupBy("t").agg(F.min("k").alias("k"))
    return rows.select("k", F.array_distinct(T.gram_hashes(F.split("t", " "), n, "whole")).alias("s"))


def jaccard_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, n: int = 5) -> DataFrame:
    """``a`` < ``b`` and ``similarity`` of different normal forms whose shingle sets are at least ``least`` alike, exactly.

    Prefix filtering: two sets can only be that alike if they share one of their
    rarest ``|s| - ceil(least * |s|) + 1`` shingles, so frequent shingles are
    never joined on, and no pair is lost. Shingles are hashes of 64 bits; those
    of one text alone are dropped by the join with the counts, and stand first
    in every order. Each group of equal normal forms is represented by its
    smallest key. The pairs of a cluster of different texts that are all alike
    are its square, as each is a link between different texts.
    """
    sets = cut(shingle_sets(df, key, text, n))
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("g"))
    shared = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(shared, "g").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("l"))
    prefix = F.col("n") - F.ceil(F.col("n") * least) + 1 - (F.col("n") - F.size("l"))
    head = lists.where(prefix > 0).select("k", "n", F.explode(F.slice("l", 1, prefix.cast("int"))).alias("x")).select("k", "n", F.col("x.g").alias("g"))
    a, b = head.alias("a"), head.alias("b")
    near = (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least)
    pairs = a.join(b, near).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.round(same / (F.size("sa") + F.size("sb") - same), 6).alias("similarity")).where(F.col("similarity") >= least)


def near_dups(df: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """``key`` of every row that a pass in order of keys drops: it is like a kept row before it, or has a kept row's words.

    The pass runs over one row of each normal form; its result is spread to all
    rows of that form. Null and empty texts take no part; texts without words
    are alike.
    """
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.sha2(F.array_join(T.words(F.col(text)), " "), 256).alias("h"), F.col(text).alias("t"))
    first = rows.groupBy("h").agg(F.min("k").alias("first"))
    edges = jaccard_pairs(rows, "k", "t", least).select(F.col("a").alias("hi"), F.col("b").alias("lo"))
    gone = greedy_drop(edges).select(F.col("lo").alias("first")).distinct().withColumn("gone", F.lit(True))
    of = rows.select("k", "h").join(first.join(gone, "first", "left"), "h")
    return of.where("gone OR k != first").select(F.col("k").alias(key))


def clusters(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``k`` and ``root``, the smallest key it is connected with, of every key of ``edges``.

    Each key takes the smallest label among its neighbours and its label's own
    label, until nothing changes: the labels' depth halves each round. A round
    is two joins, cut into the shared folder.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    while True:
        seen = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = labels.join(seen, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = step.join(labels.select(F.col("x").alias("m"), F.col("l").alias("j")), "m", "left")
        after = cut(jump.select("x", "l", F.least("m", F.coalesce("j", "m")).alias("n")))
        labels = after.select("x", F.col("n").alias("l"))
        if after.where("n != l").isEmpty():
            return labels.select(F.col("x").alias("k"), F.col("l").alias("root"))


def signatures(df: DataFrame, key: str, text: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """``k`` and ``sig``: for each permutation the least hash of the shingles; all of a text without words are the greatest number."""
    s = F.array_distinct(T.grams(T.words(T.text_of(F.col(text))), 5, "whole"))
    hashed = df.select(F.col(key).alias("k"), F.transform(s, lambda x: F.xxhash64(x)).alias("h"))
    least = [F.coalesce(F.array_min(F.transform("h", lambda x, i=i: F.xxhash64(F.lit(i), x))), F.lit(2**63 - 1)) for i in range(permutations)]
    return hashed.select("k", F.array(*least).alias("sig"))


def lsh_pairs(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``hi`` < ``lo``: keys that agree in a whole band; unverified, as the method is defined. Equal signatures are one row in the bands."""
    same = sigs.groupBy("sig").agg(F.min("k").alias("k"))
    copies = sigs.join(same.withColumnRenamed("k", "hi"), "sig").where("k != hi").select("hi", F.col("k").alias("lo"))
    keyed = same.select("k", F.explode(F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)])).alias("band"))
    x, y = keyed.alias("x"), keyed.alias("y")
    found = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("hi"), F.col("y.k").alias("lo"))
    return found.unionByName(copies).distinct()


def greedy_drop(edges: DataFrame) -> DataFrame:
    """Nodes (``lo``) that a pass in rank order drops: each that has a kept better neighbour ``hi``.

    The rounds keep every node without an undecided better neighbour and drop
    its neighbours; their fixed point is the sequential pass's result. A round
    is two joins on the remaining edges, cut into the shared folder.
    """
    left = cut(edges.select("hi", "lo").distinct())
    dropped = left.select("lo").where("false")
    while not left.isEmpty():
        heads = left.select("hi").distinct().join(left.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
        gone = cut(left.join(heads, "hi", "left_semi").select("lo").distinct())
        dropped = dropped.unionByName(gone)
        left = cut(left.join(gone.select(F.col("lo").alias("hi")), "hi", "left_anti").join(gone, "lo", "left_anti").select("hi", "lo"))
    return dropped


def fates(df: DataFrame, key: str, text: str, shard: str, held: DataFrame, near_scope: Column, bad_scope: Column, least: float = 0.8) -> DataFrame:
    """``key``, ``shard`` and ``fate`` of each row with a text: near_dup, exact_dup in its shard, contaminated, or kept.

    Near duplicates are looked for among the rows of ``near_scope``, by a greedy
    pass in order of keys; grams of ``held`` among those of ``bad_scope``. Null
    and empty texts are no documents and have no fate. Copies of one normal form
    in a shard are all contaminated or none, so the order of the rules needs no
    sequential pass; the first row of each is found by a combined minimum, not
    by sorting the shard.
    """
    docs = df.where(F.length(text) > 0)
    near = near_dups(docs.where(near_scope), key, text, least).select(F.col(key).alias("k"), F.lit(True).alias("n"))
    bad = holding(docs.where(bad_scope), key, text, held).select(F.col(key).alias("k"), F.lit(True).alias("c"))
    rows = docs.select(F.col(key).alias("k"), F.col(shard).alias("s"), same_text(F.col(text)).alias("h")).join(near, "k", "left").join(bad, "k", "left")
    first = rows.where("n IS NULL AND c IS NULL").groupBy("s", "h").agg(F.min("k").alias("first"))
    fate = F.when(F.col("n"), "near_dup").when(F.col("c"), "contaminated").when(F.col("k") != F.col("first"), "exact_dup").otherwise("kept")
    return rows.join(first, ["s", "h"], "left").select(F.col("k").alias(key), F.col("s").alias(shard), fate.alias("fate"))
