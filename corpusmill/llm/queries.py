"""The queries of problems 1 to 8 and, where SQL can express them, their SQL."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe_automaton, homoglyphs, leaks, mixture, neardup, packing, pairs, scans
from corpusmill.llm.lookalikes import LATIN, UNSEEN
from corpusmill.sources.tables import spread, table

# The reading of a text in SQL: unseen characters out, spaces and look-alikes by table, ligatures spelled out, accents composed.
_MATH = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x1D400, 0x1D800) if unicodedata.normalize("NFKC", chr(c)) != chr(c)]
_FROM = "".join(a for a, _ in _MATH) + "".join(chr(k) for k in LATIN) + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\xa0\t" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_TO = "".join(LATIN.get(ord(b), b) for _, b in _MATH) + "".join(LATIN.values()) + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  " + " " * 11 + "   "
_UNSEEN_SQL = re.sub(r"\\u([0-9a-f]{4})|\\U([0-9a-f]{8})|\\x([0-9a-f]{2})", lambda m: rf"\x{{{m[1] or m[2] or m[3]}}}", UNSEEN)
_READ = f"regexp_replace(text, '[{_UNSEEN_SQL}]+', '', 'g')"
for _a, _b in (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl")):
    _READ = f"replace({_READ}, '{_a}', '{_b}')"
_READ = f"nfc_normalize(translate({_READ}, '{_FROM.replace(chr(39), chr(39) * 2)}', '{_TO.replace(chr(39), chr(39) * 2)}'))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe_automaton.encode(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(sql="SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Decoded ids of every document with a text: equal to the text as stored."""
    ids = bpe_automaton.encode(spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")), "doc_id", "text")
    return bpe_automaton.decode(ids, "doc_id")


P7_FOUND = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower({_READ}), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower({_READ}), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (n, g)"""


@query(sql=P7_FOUND)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query()
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each leaked piece stands in the original text."""
    return leaks.found(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", spans=True)


@query(sql=f"""
WITH r AS (SELECT doc_id, text, {_READ} AS r FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM r a JOIN r b ON a.r = b.r AND a.doc_id < b.doc_id AND a.text <> b.text WHERE trim(a.r, ' ' || chr(10)) <> ''""")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return homoglyphs.pairs(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query()
def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return homoglyphs.canonical(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query()
def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a visible text and the class of texts that read the same."""
    return homoglyphs.classes(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(spread(table(spark, d, "clean_result").select("rec_id", "text", "ingested_at")), "rec_id", "text", at="ingested_at")


_P5 = """
c AS (SELECT rec_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM clean_result WHERE trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at DESC, text) = 1),
s AS (SELECT rec_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM c WHERE len(w) >= 5),
g AS (SELECT rec_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b FROM g a JOIN g b ON a.g = b.g AND a.rec_id < b.rec_id GROUP BY a.rec_id, b.rec_id HAVING count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*))),
found AS (SELECT rec_a, rec_b FROM p UNION SELECT a.rec_id, b.rec_id FROM c a JOIN c b ON a.text = b.text AND a.rec_id < b.rec_id)"""


@query(sql=f"WITH {_P5} SELECT rec_a, rec_b FROM found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


@query(sql=f"""WITH RECURSIVE {_P5}, e AS (SELECT rec_a AS x, rec_b AS y FROM found UNION SELECT rec_b, rec_a FROM found), reach AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
k AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY text) AS class_id FROM c), l AS (SELECT e.x, count(DISTINCT b.class_id) AS links FROM e JOIN k a ON a.rec_id = e.x JOIN k b ON b.rec_id = e.y AND b.class_id <> a.class_id GROUP BY e.x)
SELECT k.rec_id, k.class_id, min(r.y) AS group_id, coalesce(any_value(l.links), 0) AS links FROM reach r JOIN k ON k.rec_id = r.x LEFT JOIN l ON l.x = r.x GROUP BY k.rec_id, k.class_id""")
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record that has a like one: its group and its number of links between different texts."""
    return _near(spark, d).groups()


def _packed(spark: SparkSession, d: str) -> packing.Packed:
    p = table(spark, d, "passage").select(F.lit("passage").alias("rec_table"), F.col("id").alias("rec_id"), F.col("n_tokens").alias("tokens"))
    c = table(spark, d, "candidate").select(F.lit("candidate").alias("rec_table"), F.col("id").alias("rec_id"), F.col("context_tokens").alias("tokens"))
    return packing.Packed(p.unionByName(c))


@query(sql="""
SELECT 'passage' AS rec_table, id AS rec_id FROM passage WHERE n_tokens > 1024 AND id IS NOT NULL GROUP BY id
UNION ALL SELECT 'candidate', id FROM candidate WHERE context_tokens > 1024 AND id IS NOT NULL GROUP BY id""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that the packing had to cut, from the windows it put them in."""
    return _packed(spark, d).assigned().where("piece = 1").select("rec_table", "rec_id")


@query()
def p1_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The window of each item, or of each piece of an item longer than a window."""
    return _packed(spark, d).assigned()


@query()
def p1_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each window's items, used and unused tokens."""
    return _packed(spark, d).windows()


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    return mixture.Mixture(table(spark, d, "token_index"), table(spark, d, "source_config"))


P4_SHORT = r"""
WITH s AS (SELECT *, regexp_replace(lower(name), '[\s_\-\x{a0}]+', '', 'g') AS key FROM source_config),
v AS (SELECT build_id, regexp_replace(lower(source), '[\s_\-\x{a0}]+', '', 'g') AS key, shard, coalesce(train_tokens, 0) AS x,
        row_number() OVER (PARTITION BY build_id, regexp_replace(lower(source), '[\s_\-\x{a0}]+', '', 'g'), shard ORDER BY written_at DESC, coalesce(train_tokens, 0) DESC) AS n
      FROM token_index)
SELECT build_id, name AS source FROM v JOIN s USING (key) WHERE n = 1
GROUP BY build_id, name, token_budget, max_repeats HAVING sum(x) * max_repeats < token_budget"""


@query(sql=P4_SHORT)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).short()


@query()
def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    """Of each build and source: repeats, target and real share, and whether it falls short."""
    return _mixture(spark, d).report()


@query()
def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Rate and whole copies of each valid shard."""
    return _mixture(spark, d).copies()


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(spread(table(spark, d, "candidate").select("id", "type", "question", "answer", "context")))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passage").select(F.lit("passage").alias("rec_table"), F.col("id").alias("rec_id"), "text")
    c = table(spark, d, "clean_result").select(F.lit("clean_result").alias("rec_table"), F.col("rec_id").cast("string").alias("rec_id"), "text")
    return spread(p.unionByName(c))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(_scanned(spark, d))


@query()
def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every record with continuous readable text, and which noise it had."""
    return scans.cleaned(_scanned(spark, d))
