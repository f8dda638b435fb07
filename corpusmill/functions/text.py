"""Text primitives as Column expressions: everything here stays in the JVM.

White space and line breaks are Unicode's, as Python's ``\\s`` and
``splitlines`` have them, not Java's defaults. Null texts count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and line breaks.
SPACE = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOSPACE = r"[^\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOBLANK = SPACE.replace(r"\x1f ", r"\x1f")
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
# The same for RE2, which DuckDB uses.
SPACE_SQL = SPACE.replace(r"\u", "\\u").replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")
for _c in ("1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    SPACE_SQL = SPACE_SQL.replace(rf"\u{_c}", rf"\x{{{_c}}}")
BREAK_SQL = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends. Single blanks, the usual case, are left where they are."""
    return F.trim(F.regexp_replace(c, f"{SPACE}{{2,}}|{NOBLANK}", " "))


def lines(c: Column) -> Column:
    return F.split(c, BREAK)


def nonalnum_ratio(line: Column) -> Column:
    """Share of characters that are no ASCII letter or digit; 1 for an empty line."""
    n = F.length(line)
    signs = F.length(F.regexp_replace(line, "[A-Za-z0-9]+", ""))  # several times as fast as replacing what isn't in the class
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - (n - signs) / n)


def ascii_ratio(c: Column, chars: int = 5000) -> Column:
    """Share of ASCII among the first ``chars`` characters; 0 for an empty text."""
    s = F.substring(c, 1, chars)
    n = F.length(s)
    return F.when(n == 0, F.lit(0.0)).when(F.octet_length(s) == n, F.lit(1.0)).otherwise(F.length(F.regexp_replace(s, r"[^\x00-\x7F]+", "")) / n)


def normalize(c: Column) -> Column:
    """Lower case, white space collapsed: the corpus' normal form."""
    return collapse(F.lower(c))


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 of the normal form; other letters part words."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def tokens(c: Column) -> Column:
    """Pieces between white space, as they stand."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def grams(w: Column, n: int, short: str = "none") -> Column:
    """Runs of ``n`` words, joined by blanks.

    Of fewer words than ``n``: no gram (``none``), or all words as one gram
    (``whole``); no words never give a gram.
    """

    def of(v: Column) -> Column:
        k = F.size(v)
        full = F.transform(F.sequence(F.lit(1), F.greatest(k - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(v, i, n), " "))
        one = F.array(F.array_join(v, " ")) if short == "whole" else F.array().cast("array<string>")
        return F.when(k >= n, full).when(k > 0, one).otherwise(F.array().cast("array<string>"))

    return let(w, of)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, not wherever ``f`` names it; optimiser and lambdas would copy the expression."""
    return F.transform(F.array(value), f)[0]


def gram_hashes(w: Column, n: int, short: str = "none") -> Column:
    """As ``grams``, each as a hash of 64 bits, made without its text."""

    def of(v: Column) -> Column:
        k = F.size(v)
        full = F.transform(F.sequence(F.lit(0), F.greatest(k - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(v, i + j) for j in range(n)]))
        one = F.array(F.xxhash64(F.lit("whole"), F.array_join(v, " "))) if short == "whole" else F.array().cast("array<bigint>")
        return F.when(k >= n, full).when(k > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(w, of)


def run_lengths(c: Column) -> Column:
    """How often each element occurs in an array, by sorting it: no element is compared with all others."""

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda x: F.zip_with(x, F.concat(F.slice(x, 2, F.size(x)), F.array(n)), lambda a, b: b - a))

    return F.when(F.size(c) == 0, F.array().cast("array<int>")).otherwise(let(F.sort_array(c), of))


def repetition_ratio(w: Column, n: int = 4, top: int = 10) -> Column:
    """Share of the ``top`` most frequent n-grams in all; 0 of fewer than 2n words. Counted exactly in the row, so nothing is shuffled."""

    def share(g: Column) -> Column:
        counts = F.slice(F.sort_array(run_lengths(g), asc=False), 1, top)
        return F.aggregate(counts, F.lit(0), lambda a, x: a + x) / F.size(g)

    return let(w, lambda v: F.when(F.size(v) < 2 * n, F.lit(0.0)).otherwise(let(grams(v, n), share)))


def is_repetitive(w: Column, most: float, n: int = 4, top: int = 10) -> Column:
    """Whether ``repetition_ratio`` is above ``most``.

    Most texts have so many different n-grams that their ``top`` can't reach
    that share wherever the repeats fall; only of the others is it counted.
    """
    can = lambda v: let(gram_hashes(v, n), lambda g: F.size(g) - F.size(F.array_distinct(g)) + top > F.size(g) * most)
    return let(w, lambda v: F.when(F.size(v) < 2 * n, F.lit(False)).otherwise(F.when(can(v), repetition_ratio(v, n, top) > most).otherwise(False)))


def proxy_tokens(chars: Column) -> Column:
    """Tokens estimated from characters, four to one."""
    return F.floor(chars / F.lit(4.0)).cast("bigint")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.str.normalize("NFKC")


def question_form(c: Column, ascii_only: bool = False) -> Column:
    """Normal form of questions and answers: NFKC, lower case, punctuation to blanks, collapsed; underscores stay."""
    s = c if ascii_only else nfkc(c)
    return collapse(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", " "))


def fits_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the case-blind patterns is found."""
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")")
