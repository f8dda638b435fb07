"""Instruction pairs: passages, format rules, judgements, selection, rendering and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dedup, similarity
from corpusmill.operators.order import ranked
from corpusmill.sources.tables import cut

PASSAGE_CHARS, PASSAGE_TOKENS, PASSAGE_LEAST = 500, 700, 120
QUESTION_CHARS, ANSWER_CHARS, ANSWER_WORDS, KEEP_SCORE = 15, 20, 150, 4
#: Sizes and thresholds of the selection: characters from which equal answers are boilerplate, most pairs kept and held out, words of a gram, least cosines of a near duplicate and of a held-out question's like.
ANSWER_LONG, KEPT_MOST, EVAL_PAIRS, GRAM, NEAR_COSINE, HELD_COSINE = 200, 3000, 200, 13, 0.92, 0.88
# Shares of the selection's sources and of its question types.
SOURCE_MIX = {"case-law": 0.40, "sec": 0.40, "fineweb-edu": 0.20}
TYPE_MIX = {"lookup": 0.50, "reasoning": 0.30, "unanswerable": 0.20}
# The refusal a pair without an answer must have, what marks a refusal, and the system's prompt.
REFUSAL = "The provided context does not say."
REFUSAL_MARKS = ("does not say", "do not know", "does not provide", "not enough", "does not contain", "not stated", "no information", "does not mention")
SYSTEM = "You are a legal and financial assistant.\nAnswer only from the provided context.\nIf the context is not enough, say you do not know."
# Fixed patterns: a question that speaks of its source, an answer that breaks off.
CONTEXT_LEAK = r"\b(the|this|that|provided|given|above|following)\s+(passage|context|document|excerpt|text|filing|snippet)\b"
BROKEN_OFF = r"(\.\.\.|…)\s*$"


def passage(c: Column, most: int = PASSAGE_TOKENS) -> Column:
    """A text cut to ``most`` tokens (pieces between blanks), at a sentence's end where half of it is left."""
    t = T.collapse(T.text_of(c))

    def cut(w: Column) -> Column:
        whole = F.array_join(F.slice(w, 1, most), " ")
        ended = F.regexp_extract(whole, r"(?s)^(.*[.!?])\s", 1)
        return F.when(F.size(w) <= most, F.array_join(w, " ")).when((ended != "") & (F.length(ended) >= 0.5 * F.length(whole)), ended).otherwise(whole)

    return F.when(F.length(t) >= PASSAGE_CHARS, T.let(F.split(t, " "), cut))


def format_fault(kind: Column, question: Column, answer: Column) -> Column:
    """The first rule a pair breaks, or null. Null fields count as empty; rules for answers depend on ``kind``."""
    q, a = T.text_of(question), T.text_of(answer)
    q, a = (F.regexp_replace(x, f"^{T.SPACE}+|{T.SPACE}+$", "") for x in (q, a))
    refused = T.question_form(a) == T.question_form(F.lit(REFUSAL), ascii_only=True)
    open_ = F.coalesce(kind, F.lit("")) == "unanswerable"
    return (
        F.when((q == "") | (a == ""), "empty_field").when(F.length(q) < QUESTION_CHARS, "question_too_short").when(~F.contains(q, F.lit("?")), "not_a_question")
        .when(q.rlike("(?i)" + CONTEXT_LEAK), "context_leak_in_question").when(a.rlike(BROKEN_OFF), "answer_truncated")
        .when(open_ & ~refused, "refusal_text_wrong").when(open_, F.lit(None))
        .when(F.length(a) < ANSWER_CHARS, "answer_too_short").when(F.size(T.tokens(a)) > ANSWER_WORDS, "answer_too_long").when(refused, "unexpected_refusal")
    )


def judged(score: Column, grounded: Column, real: Column, refusal_ok: Column) -> tuple[Column, Column]:
    """Verdict and drop reason from a judge's marks; the judge's own verdict is not used, missing marks fail."""
    s, g, r, o = F.coalesce(score, F.lit(0)), *(F.coalesce(x, F.lit(False)) for x in (grounded, real, refusal_ok))
    why = F.when(s < KEEP_SCORE, "judge_score").when(~g, "judge_ungrounded").when(~r, "judge_not_a_question").when(~o, "judge_refusal_wrong")
    return F.when(why.isNull(), "keep").otherwise("drop"), why


def is_refusal(c: Column) -> Column:
    low = F.lower(T.text_of(c))
    out = F.lit(False)
    for m in REFUSAL_MARKS:
        out = out | F.contains(low, F.lit(m))
    return out


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"<|bos|><|system|>{SYSTEM}<|user|>Context:\n"), T.text_of(context), F.lit("\n\nQuestion: "), T.text_of(question), F.lit("<|assistant|>"))


def padded(prompt_ids: Column, answer_ids: Column, width: int, pad: int = 0) -> Column:
    """tokens, loss_mask (the answer) and attn_mask of one example in a row of ``width``; null where it doesn't fit."""
    p, n = F.size(prompt_ids), F.size(prompt_ids) + F.size(answer_ids)
    fill = lambda x, k: F.array_repeat(F.lit(x), F.greatest(k, F.lit(0)))
    row = F.struct(
        F.concat(prompt_ids, answer_ids, fill(pad, width - n)).alias("tokens"), F.concat(fill(0, p), fill(1, n - p), fill(0, width - n)).alias("loss_mask"), F.concat(fill(1, n), fill(0, width - n)).alias("attn_mask"),
    )
    return F.when(n <= width, row)


def labels(tokens: Column, mask: Column, ignore: int = -100) -> Column:
    return F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t).otherwise(ignore))


def shuffled(seed: str, key: Column) -> Column:
    """A reproducible order: the same in every engine, on every partitioning."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def allocate(parts: DataFrame, share: str, position: str, total: Column | int, by: list[str] | None = None) -> DataFrame:
    """``parts`` with ``quota``: largest remainders, ties in order of ``position``, so that quotas sum to ``total`` where the shares sum to 1.

    The parts are the few kinds or sources of a mix, one task's work; ``by``
    tells several mixes apart.
    """
    by = by or [F.lit(1)]
    exact = F.col(share) * total
    base = parts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    every = Window.partitionBy(*by)
    order = Window.partitionBy(*by).orderBy(F.desc("_rest"), position)
    more = F.row_number().over(order) <= total - F.sum("_floor").over(every)
    return base.withColumn("quota", (F.col("_floor") + more.cast("int")).cast("bigint")).drop("_floor", "_rest")


def first_ids(df: DataFrame, key: str, group: Column) -> DataFrame:
    """The smallest ``key`` of each group; combined before the shuffle."""
    return df.groupBy(group.alias("_g")).agg(F.min(key).alias(key)).select(key)


def vector_dups(df: DataFrame, key: str, vector: str, order: list[Column | str], least: float = NEAR_COSINE) -> DataFrame:
    """``key`` of every row that a pass in ``order`` drops, as its vector is at least ``least`` like a kept one's.

    Rows of one vector are one row in the pass, the first of them; the others
    are dropped with it or because of it.
    """
    place = cut(ranked(df.where(F.col(vector).isNotNull()).select(key, vector, *[c for c in order if isinstance(c, str) and c != key]), [], order).withColumn("_h", F.xxhash64(vector)))
    first = place.groupBy("_h").agg(F.min("place").alias("first"), F.min_by(vector, "place").alias("v"))
    edges = similarity.pairs(first, "first", "v", least).select(F.col("a").alias("hi"), F.col("b").alias("lo"))
    gone = dedup.greedy_drop(edges).select(F.col("lo").alias("first")).distinct().withColumn("gone", F.lit(True))
    of = place.select(key, "place", "_h").join(first.select("_h", "first").join(gone, "first", "left"), "_h")
    return of.where("gone OR place != first").select(key)


def stratified(pool: DataFrame, key: str, source: str, kind: str, order: str, most: int = KEPT_MOST + EVAL_PAIRS, sources: dict[str, float] | None = None, kinds: dict[str, float] | None = None) -> DataFrame:
    """``key`` of as many rows as the scarcest source allows at the shares of ``sources``, ``most`` at most.

    Inside a source each kind gets its share; what kinds lack is filled from the
    source's other rows. Rows are taken in ``order``. Ranks are only needed up
    to ``most``, which the planner keeps to in each task before the shuffle.
    """
    spark = pool.sparkSession
    sources, kinds = sources or SOURCE_MIX, kinds or TYPE_MIX
    mix = spark.createDataFrame([(s, float(x), i) for i, (s, x) in enumerate(sources.items())], f"{source} string, share double, pos int")
    have = pool.groupBy(source).agg(F.count("*").alias("n")).join(mix, source)
    total = min(int(have.agg(F.min(F.floor(F.col("n") / F.col("share")))).first()[0] or 0), most)
    want = allocate(mix, "share", "pos", total).select(source, F.col("quota").alias("want"))
    each = F.inline(F.array(*[F.struct(F.lit(k).alias(kind), F.lit(float(x)).alias("share"), F.lit(i).alias("pos")) for i, (k, x) in enumerate(kinds.items())]))
    of_kind = allocate(want.select(source, "want", each), "share", "pos", F.col("want"), [source]).select(source, kind, F.col("quota").alias("_q"))
    r = pool.select(key, source, kind, order).withColumn("_r", F.row_number().over(Window.partitionBy(source, kind).orderBy(order, key))).where(F.col("_r") <= most)
    r = r.join(of_kind, [source, kind], "left").withColumn("_first", F.col("_r") <= F.coalesce("_q", F.lit(0)))
    n = F.row_number().over(Window.partitionBy(source).orderBy(F.desc("_first"), order, key))
    return r.withColumn("_n", n).where(F.col("_n") <= most).join(want, source).where(F.col("_n") <= F.col("want")).select(key)


def select_pairs(pairs: DataFrame, seed: str = "11", near: float = NEAR_COSINE, held: float = HELD_COSINE, long: int = ANSWER_LONG, gram: int = GRAM, evals: int = EVAL_PAIRS, most: int = KEPT_MOST) -> DataFrame:
    """``id`` and ``fate`` of each of ``pairs`` (id, source, type, question, answer, verdict, score, vector): the whole selection.

    In this order: ``judge_fail`` (the verdict isn't keep), ``exact_dup`` (a
    question of the same form under a smaller id), ``boilerplate_answer`` (the
    same for answers longer than ``long``), ``near_dup`` (its question's vector
    is like that of a better pair), ``stratify_drop`` (outside the mix of
    sources and types), ``eval`` (held out), ``eval_contaminated`` (its question
    shares ``gram`` words with a held-out one, or its vector is ``held`` like
    one), ``kept``. Ids must be unique; null fields count as empty, pairs
    without a vector are never near duplicates. From the stratification on, no
    more than ``most + evals`` pairs are left.
    """
    form = lambda c: F.sha1(T.question_form(T.text_of(F.col(c))))
    ids = lambda df, fate: df.select("id", F.lit(fate).alias("fate"))
    good = pairs.where(F.coalesce("verdict", F.lit("")) == "keep")
    out = ids(pairs.where(F.coalesce("verdict", F.lit("")) != "keep"), "judge_fail")
    once = cut(good.join(first_ids(good, "id", form("question")), "id", "left_semi"))
    out = out.unionByName(ids(good.join(once, "id", "left_anti"), "exact_dup"))
    is_long = F.length("answer") > long
    own = once.where(F.coalesce(~is_long, F.lit(True))).select("id").unionByName(first_ids(once.where(is_long), "id", form("answer")))
    fresh = cut(once.join(own, "id", "left_semi").withColumns({"_worse": -F.coalesce("score", F.lit(0)), "_o": shuffled(seed, F.col("id"))}))
    out = out.unionByName(ids(once.join(fresh, "id", "left_anti"), "boilerplate_answer"))
    dups = vector_dups(fresh, "id", "vector", ["_worse", "_o", "id"], near)
    pool = cut(fresh.join(dups, "id", "left_anti"))
    out = out.unionByName(ids(fresh.join(pool, "id", "left_anti"), "near_dup"))
    chosen = cut(pool.join(stratified(pool, "id", "source", "type", "_o", most + evals), "id", "left_semi"))
    out = out.unionByName(ids(pool.join(chosen, "id", "left_anti"), "stratify_drop"))
    eval_ = cut(chosen.withColumn("_e", shuffled(seed + ":eval", F.col("id"))).orderBy("_e", "id").limit(evals))
    train = chosen.join(eval_, "id", "left_anti")
    w = F.filter(F.split(T.question_form(T.text_of(F.col("question"))), " "), lambda x: x != "")
    grams = lambda x: x.select("id", F.explode(F.array_distinct(T.grams(w, gram, "whole"))).alias("g"))
    shared = grams(train).join(grams(eval_).select("g").distinct(), "g", "left_semi").select("id")
    key = train.select("id", F.xxhash64("id").alias("k"), "vector")
    close = similarity.against(key, "k", "vector", eval_, "vector").where(F.round("best", 6) >= held).select("k")
    bad = cut(shared.unionByName(key.join(close, "k", "left_semi").select("id")).distinct())
    out = out.unionByName(ids(eval_, "eval")).unionByName(ids(train.join(bad, "id", "left_semi"), "eval_contaminated"))
    return out.unionByName(ids(train.join(bad, "id", "left_anti"), "kept"))
