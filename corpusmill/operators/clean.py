"""The cleaning chain: each document kept or dropped for its first failing rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

LINE_CHARS, LINE_NONALNUM, DOC_CHARS, REPETITION = 40, 0.30, 600, 0.50
OCR_RATIO, OCR_TOKENS = 0.20, 50
# Lines of forms that carry no text.
BOILERPLATE = (
    r"^\s*form\s+10[-\s]?[kq]\b.*$",
    r"^\s*page\s+\d+\s+of\s+\d+\s*$",
    r"^\s*table\s+of\s+contents\s*$",
    r"^\s*/s/\s*.*$",
    r"^\s*all\s+rights\s+reserved.*$",
    r"^\s*united\s+states\s+securities\s+and\s+exchange\s+commission\s*$",
    r"^\s*securities\s+and\s+exchange\s+commission\s*$",
    r"^\s*washington,?\s+d\.?\s?c\.?\s+\d{5}\s*$",
    r"^\s*\[?\s*x\s*\]?\s*$",
)


_LEAD = r"^\s*"
#: One pattern with a single anchor, so that a line is looked at once, not at each place for each form.
_BOILERPLATE = f"(?i){_LEAD}(?:" + "|".join(p.removeprefix(_LEAD) for p in BOILERPLATE) + ")"


def kept_lines(c: Column) -> Column:
    """Collapsed lines that are long enough and not mostly signs."""
    return F.filter(F.transform(T.lines(c), T.collapse), lambda x: (F.length(x) >= LINE_CHARS) & (T.nonalnum_ratio(x) <= LINE_NONALNUM))


def filter_lines(c: Column) -> Column:
    return F.array_join(kept_lines(c), "\n")


def is_boilerplate(line: Column) -> Column:
    return line.rlike(_BOILERPLATE)


def strip_boilerplate(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_boilerplate(x)), "\n")


def cleaned(c: Column) -> Column:
    """Both line rules in one pass over the lines."""
    return F.array_join(F.filter(kept_lines(c), lambda x: ~is_boilerplate(x)), "\n")


def is_english(c: Column, detector: Callable[[Column], Column] | None = None) -> Column:
    """By the share of ASCII; between 0.90 and 0.99 by ``detector``, which gives a boolean, or null where it fails; then above 0.95."""
    r = T.ascii_ratio(c)
    by_share = r > 0.95
    return F.when(r >= 0.99, True).when(r < 0.90, False).otherwise(F.coalesce(detector(c), by_share) if detector else by_share)


def nonword_ratios(df: DataFrame, key: str, text: Column, dictionary: DataFrame, bound: int = 2_000_000) -> DataFrame:
    """``key``, ``tokens`` and ``ratio``: the share of words of three letters or more that the dictionary lacks.

    ``ratio`` is 0 of fewer than 50 words. Each word is looked up once for each
    document; the dictionary is broadcast only when its counted size is within
    ``bound`` words. An empty dictionary is an error, not a silent pass.
    """
    known = dictionary.select(F.lower("word").alias("w")).where("w IS NOT NULL AND w != ''").distinct()
    n = known.limit(bound + 1).count()
    if not n:
        raise ValueError("the dictionary is empty")
    low = F.transform(F.regexp_extract_all(T.text_of(text), F.lit("([A-Za-z]{3,})"), F.lit(1)), F.lower)
    each = df.select(F.col(key).alias("k"), F.explode_outer(low).alias("w")).groupBy("k", "w").agg(F.count("w").alias("n"))
    known = known.withColumn("known", F.lit(1))
    hits = each.join(F.broadcast(known) if n <= bound else known, "w", "left")
    of = hits.groupBy("k").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    return of.select(F.col("k").alias(key), "tokens", F.when(F.col("tokens") < OCR_TOKENS, F.lit(0.0)).otherwise(F.col("unknown") / F.col("tokens")).alias("ratio"))


def disposition(df: DataFrame, text: str = "text", detector: Callable[[Column], Column] | None = None, ocr: Column | None = None) -> DataFrame:
    """``df`` with ``reason``, ``kept``, ``clean_text`` (empty where dropped), ``raw_chars`` and ``clean_chars``.

    ``ocr``: a boolean column of documents that fail the dictionary rule (see
    ``with_ocr``). The order of the rules is part of the result. Nothing is
    shuffled.
    """
    raw = T.text_of(F.col(text))
    out = df.withColumn("_clean", cleaned(raw))
    c = F.col("_clean")
    # one value each, so that no rule computes the cleaned text again
    reason = (
        F.when(F.length(c) < DOC_CHARS, "too_short")
        .when(T.is_repetitive(F.split(c, "[ \n]"), REPETITION), "repetitive")  # what is left has no other white space
        .when(~is_english(c, detector), "non_english")
    )
    if ocr is not None:
        reason = reason.when(ocr, "ocr")
    out = out.withColumn("reason", reason.otherwise("kept"))
    kept = F.col("reason") == "kept"
    return out.withColumns({"kept": kept, "clean_text": F.when(kept, c).otherwise(""), "raw_chars": F.length(raw), "clean_chars": F.length(c)}).drop("_clean")


def with_ocr(df: DataFrame, key: str, text: str, strict: str, dictionary: DataFrame, detector: Callable[[Column], Column] | None = None) -> DataFrame:
    """``disposition`` with the dictionary rule where the boolean column ``strict`` is true (null: not).

    Only documents that pass the rules before it are looked up, by their
    cleaned text. ``key`` must be unique and not null.
    """
    first = disposition(df, text, detector)
    passed = first.where(F.col("kept") & F.coalesce(strict, F.lit(False))).select(F.col(key).alias("_key"), "clean_text")
    bad = nonword_ratios(passed, "_key", F.col("clean_text"), dictionary).where(F.col("ratio") > OCR_RATIO).select(F.col("_key").alias(key), F.lit(True).alias("_ocr"))
    ocr = F.col("kept") & F.coalesce("_ocr", F.lit(False))
    out = first.join(bad, key, "left").withColumns({"reason": F.when(ocr, "ocr").otherwise(F.col("reason")), "clean_text": F.when(ocr, "").otherwise(F.col("clean_text")), "kept": F.col("kept") & ~ocr})
    return out.drop("_ocr")


def budget_cut(df: DataFrame, by: list[str], order: str, chars: str, cap_tokens: Column) -> DataFrame:
    """Rows up to and with the one that fills the cap of estimated tokens, in ``order``, for each shard ``by``."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_spent", F.coalesce(F.sum(chars).over(before), F.lit(0)) / 4.0).where(F.col("_spent") < cap_tokens).drop("_spent")
