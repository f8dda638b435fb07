"""Queries of the cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import clean
from corpusmill.plans.registry import query
from corpusmill.sources.tables import spread, table

_WS, _BR = T.SPACE_SQL, T.BREAK_SQL
#: Kept lines of each document; the condition of a line's boilerplate; the cleaned text; its reason.
_LINES = rf"""
docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS raw FROM documents),
kept_lines AS (SELECT doc_id, source, lang, raw, list_filter(list_transform(regexp_split_to_array(raw, '{_BR}'), lambda l: trim(regexp_replace(l, '{_WS}+', ' ', 'g'))),
   lambda l: length(l) >= 40 AND 1.0::DOUBLE - length(regexp_replace(l, '[^A-Za-z0-9]', '', 'g'))::DOUBLE / length(l) <= 0.3::DOUBLE) AS ls FROM docs)"""
_BOILER = "(?i)(?:" + "|".join(clean.BOILERPLATE) + ")"
_CLEAN = rf"""{_LINES},
cleaned AS (SELECT doc_id, source, lang, raw, array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '{_BOILER}')), chr(10)) AS c FROM kept_lines),
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(c, '{_WS}+'), lambda w: w <> '') AS w FROM cleaned),
gr AS (SELECT doc_id, len(w) - 3 AS n, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM toks WHERE len(w) >= 8),
cnt AS (SELECT doc_id, n, g, count(*) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, g) AS r FROM gr GROUP BY doc_id, n, g),
rep AS (SELECT doc_id, sum(k)::DOUBLE / any_value(n) AS ratio FROM cnt WHERE r <= 10 GROUP BY doc_id),
asc_ AS (SELECT doc_id, CASE WHEN length(c) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(substring(c, 1, 5000), '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(substring(c, 1, 5000)) END AS a FROM cleaned),
reasoned AS (SELECT doc_id, source, lang, raw, c, CASE WHEN length(c) < 600 THEN 'too_short' WHEN coalesce(rep.ratio, 0) > 0.5 THEN 'repetitive' WHEN NOT (a >= 0.99 OR (a >= 0.90 AND a > 0.95)) THEN 'non_english' ELSE 'kept' END AS reason
  FROM cleaned LEFT JOIN rep USING (doc_id) JOIN asc_ USING (doc_id))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    return clean.disposition(_docs(spark, d).select("doc_id", "source", "text"))


@query(rf"WITH {_LINES} SELECT doc_id, len(ls)::BIGINT AS n_lines, length(array_to_string(ls, chr(10)))::BIGINT AS chars, md5(array_to_string(ls, chr(10))) AS hash FROM kept_lines")
def line_filter(spark: SparkSession, d: str) -> DataFrame:
    c = clean.filter_lines(T.text_of(F.col("text")))
    n = F.when(c == "", 0).otherwise(F.size(F.split(c, "\n")))
    return _docs(spark, d).select("doc_id", n.cast("bigint").alias("n_lines"), F.length(c).cast("bigint").alias("chars"), F.md5(c).alias("hash"))


# A line of each form; the tables hold none, so each text gets one before it and one behind.
_FORMS = ("Form 10-K annual report", "page 3 of 17", "Table of  Contents", "/s/ J. Name", "All rights reserved by the issuer", "United States Securities and Exchange Commission", "Securities and Exchange Commission", "Washington, D.C. 20549", "[ x ]", "the form 10-K of the year", "page three of nine")
_FORM_SQL = "['" + "', '".join(_FORMS) + f"'][(doc_id + {{}}) % {len(_FORMS)} + 1]"
_FRAMED = rf"framed AS (SELECT doc_id, {_FORM_SQL.format(0)} || chr(10) || coalesce(text, '') || chr(10) || {_FORM_SQL.format(4)} AS t FROM documents), fl AS (SELECT doc_id, regexp_split_to_array(t, chr(10)) AS ls FROM framed)"


@query(rf"WITH {_FRAMED} SELECT doc_id, len(list_filter(ls, lambda l: regexp_matches(l, '{_BOILER}')))::BIGINT AS boilerplate, md5(array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '{_BOILER}')), chr(10))) AS hash FROM fl")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Form lines of each text and the hash of what is left without them."""
    form = lambda k: F.element_at(F.array(*map(F.lit, _FORMS)), ((F.col("doc_id") + k) % len(_FORMS) + 1).cast("int"))
    t = F.concat(form(0), F.lit("\n"), T.text_of(F.col("text")), F.lit("\n"), form(4))
    framed = _docs(spark, d).select("doc_id", t.alias("t"))
    return framed.select("doc_id", F.size(F.filter(F.split("t", "\n"), clean.is_boilerplate)).cast("bigint").alias("boilerplate"), F.md5(clean.strip_boilerplate(F.col("t"))).alias("hash"))


@query(rf"WITH {_LINES}, one AS (SELECT doc_id, unnest(regexp_split_to_array(raw, '{_BR}')) AS l FROM docs) SELECT doc_id, count(*) AS n_lines, round(max(CASE WHEN length(l) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - length(regexp_replace(l, '[^A-Za-z0-9]', '', 'g'))::DOUBLE / length(l) END), 6) AS worst FROM one GROUP BY doc_id")
def line_nonalnum(spark: SparkSession, d: str) -> DataFrame:
    """The highest share of signs in a line of each document."""
    ls = T.lines(T.text_of(F.col("text")))
    return _docs(spark, d).select("doc_id", F.size(ls).cast("bigint").alias("n_lines"), F.round(F.array_max(F.transform(ls, T.nonalnum_ratio)), 6).alias("worst"))


@query(rf"WITH {_CLEAN} SELECT doc_id, round(coalesce(rep.ratio, 0), 6)::DOUBLE AS ratio, coalesce(rep.ratio, 0) > 0.5 AS repetitive FROM toks LEFT JOIN rep USING (doc_id)")
def repetition_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each document's share of its ten commonest 4-grams."""
    r = T.repetition_ratio(T.tokens(clean.cleaned(T.text_of(F.col("text")))))
    return _docs(spark, d).select("doc_id", r.alias("r")).select("doc_id", F.round("r", 6).alias("ratio"), (F.col("r") > clean.REPETITION).alias("repetitive"))


@query("SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0.0::DOUBLE ELSE length(regexp_replace(substring(text, 1, 5000), '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / length(substring(text, 1, 5000)) END, 6) AS ratio FROM documents")
def ascii_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(T.ascii_ratio(T.text_of(F.col("text"))), 6).alias("ratio"))


@query(rf"WITH {_CLEAN} SELECT lang, count(*) AS docs, count(*) FILTER (a >= 0.99) AS sure, count(*) FILTER (a >= 0.90 AND a < 0.99) AS doubtful, count(*) FILTER (a >= 0.99 OR (a >= 0.90 AND a > 0.95)) AS english FROM asc_ JOIN cleaned USING (doc_id) GROUP BY lang")
def language_gate(spark: SparkSession, d: str) -> DataFrame:
    c = clean.cleaned(T.text_of(F.col("text")))
    r = _docs(spark, d).select("lang", T.ascii_ratio(c).alias("a"), clean.is_english(c).alias("e"))
    return r.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("a") >= 0.99).alias("sure"), F.count_if((F.col("a") >= 0.90) & (F.col("a") < 0.99)).alias("doubtful"), F.count_if("e").alias("english"))


@query(rf"WITH {_CLEAN} SELECT doc_id, CASE WHEN a >= 0.99 THEN true WHEN a < 0.90 THEN false ELSE coalesce(lower(lang) = 'en', a > 0.95) END AS english FROM asc_ JOIN cleaned USING (doc_id)")
def language_detected(spark: SparkSession, d: str) -> DataFrame:
    """The gate with a detector for doubtful texts; the column of languages stands for one, and fails where it is null."""
    c = clean.cleaned(T.text_of(F.col("text")))
    return _docs(spark, d).select("doc_id", clean.is_english(c, lambda _: F.lower("lang") == "en").alias("english"))


@query(rf"WITH {_CLEAN} SELECT doc_id, source, reason, length(raw)::BIGINT AS raw_chars, length(c)::BIGINT AS clean_chars, md5(CASE WHEN reason = 'kept' THEN c ELSE '' END) AS hash FROM reasoned")
def clean_disposition(spark: SparkSession, d: str) -> DataFrame:
    r = _reasons(spark, d)
    return r.select("doc_id", "source", "reason", F.col("raw_chars").cast("bigint"), F.col("clean_chars").cast("bigint"), F.md5("clean_text").alias("hash"))


_DICT = "dict AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}')) AS w FROM passage))"


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The passages' words stand for a word list."""
    return table(spark, d, "passage").select(F.explode(F.regexp_extract_all(T.text_of(F.col("text")), F.lit("([A-Za-z]{3,})"), F.lit(1))).alias("word"))


@query(rf"""WITH {_CLEAN}, {_DICT}, cw AS (SELECT doc_id, lower(unnest(regexp_extract_all(c, '[A-Za-z]{{3,}}'))) AS w FROM reasoned WHERE reason = 'kept'),
bad AS (SELECT doc_id FROM cw LEFT JOIN dict USING (w) GROUP BY doc_id HAVING count(*) >= 50 AND count(*) FILTER (dict.w IS NULL)::DOUBLE / count(*) > 0.2),
x AS (SELECT r.*, reason = 'kept' AND coalesce(s.strict_ocr, false) AND b.doc_id IS NOT NULL AS ocr FROM reasoned r LEFT JOIN source_config s ON r.source = s.name LEFT JOIN bad b ON r.doc_id = b.doc_id)
SELECT doc_id, CASE WHEN ocr THEN 'ocr' ELSE reason END AS reason, length(c)::BIGINT AS clean_chars, md5(CASE WHEN reason = 'kept' AND NOT ocr THEN c ELSE '' END) AS hash FROM x""")
def strict_disposition(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, the dictionary rule in it for the sources that ask for it."""
    s = table(spark, d, "source_config").select(F.col("name").alias("source"), "strict_ocr")
    docs = _docs(spark, d).select("doc_id", "source", "text").join(s, "source", "left")
    r = clean.with_ocr(docs, "doc_id", "text", "strict_ocr", _dictionary(spark, d))
    return r.select("doc_id", "reason", F.col("clean_chars").cast("bigint"), F.md5("clean_text").alias("hash"))


_REPORT = "count(*) AS streamed, count(*) FILTER (reason = 'kept') AS kept, coalesce(sum(length(c)) FILTER (reason = 'kept'), 0)::BIGINT // 4 AS est_tokens, count(*) FILTER (reason = 'too_short') AS too_short, count(*) FILTER (reason = 'repetitive') AS repetitive, count(*) FILTER (reason = 'non_english') AS non_english"


def _report() -> list:
    is_ = lambda r: F.count_if(F.col("reason") == r)
    return [
        F.count("*").alias("streamed"), is_("kept").alias("kept"),
        T.proxy_tokens(F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("clean_chars"))), F.lit(0))).alias("est_tokens"),
        is_("too_short").alias("too_short"), is_("repetitive").alias("repetitive"), is_("non_english").alias("non_english"),
    ]


@query(rf"WITH {_CLEAN} SELECT source, {_REPORT} FROM reasoned GROUP BY source")
def drop_report(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).groupBy("source").agg(*_report())


@query(rf"WITH {_CLEAN} SELECT source, {_REPORT}, round(count(*) FILTER (reason = 'kept')::DOUBLE / greatest(count(*), 1), 6) AS keep_rate FROM reasoned GROUP BY ROLLUP (source)")
def drop_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The report with its grand total, the row without a source, in one pass."""
    r = _reasons(spark, d).rollup("source").agg(*_report())
    return r.withColumn("keep_rate", F.round(F.col("kept") / F.greatest(F.col("streamed"), F.lit(1)), 6))


@query(rf"WITH {_CLEAN}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM reasoned) WHERE n <= 20), t AS (SELECT source, count(*) AS docs FROM documents GROUP BY source) SELECT s.source, any_value(t.docs) AS docs, round(count(*) FILTER (reason = 'kept')::DOUBLE / 20, 3) AS keep_rate, round(any_value(t.docs) * (coalesce(sum(length(c)) FILTER (reason = 'kept'), 0)::DOUBLE / 20) / 4, 3) AS est_tokens FROM s JOIN t USING (source) GROUP BY s.source")
def yield_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a source will give, from its first 20 documents; the divisor is the number asked for, as in the measure run."""
    docs = _docs(spark, d).select("doc_id", "source", "text")
    first = clean.disposition(head_of(docs, "source", "doc_id", 20))
    total = docs.groupBy("source").agg(F.count("*").alias("docs"))
    chars = F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("clean_chars"))), F.lit(0))
    of = first.groupBy("source").agg(F.round(F.count_if(F.col("reason") == "kept") / 20, 3).alias("keep_rate"), chars.alias("chars"))
    return of.join(total, "source").select("source", "docs", "keep_rate", F.round(F.col("docs") * (F.col("chars") / 20) / 4, 3).alias("est_tokens"))


def head_of(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; the planner keeps at most n rows of a group in each task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


@query(rf"WITH {_CLEAN}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM reasoned) WHERE n <= 10) SELECT source, {_REPORT} FROM s GROUP BY source")
def smoke_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report over the first ten documents of each source."""
    return clean.disposition(head_of(_docs(spark, d).select("doc_id", "source", "text"), "source", "doc_id", 10)).groupBy("source").agg(*_report())


_OCR = rf"""{_DICT}, tk AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{3,}}'))) AS w FROM documents),
ratios AS (SELECT doc_id, count(*) AS tokens, count(*) FILTER (dict.w IS NULL) AS unknown FROM tk LEFT JOIN dict USING (w) GROUP BY doc_id)"""


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    return clean.nonword_ratios(_docs(spark, d), "doc_id", F.col("text"), _dictionary(spark, d))


@query(rf"WITH {_OCR} SELECT documents.doc_id, coalesce(tokens, 0)::BIGINT AS tokens, CASE WHEN coalesce(tokens, 0) < 50 THEN 0.0::DOUBLE ELSE round(unknown::DOUBLE / tokens, 6) END AS ratio FROM documents LEFT JOIN ratios USING (doc_id)")
def ocr_nonword_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of words that the passages, here the dictionary, lack."""
    return _ratios(spark, d).select("doc_id", "tokens", F.round("ratio", 6).alias("ratio"))


@query(rf"WITH {_OCR}, th AS (SELECT unnest([0.10, 0.15, 0.20, 0.25, 0.30])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (unknown::DOUBLE / tokens > threshold) AS docs, count(*) AS measured FROM ratios, th WHERE tokens >= 50 GROUP BY threshold")
def ocr_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each threshold would drop, in one pass over the ratios."""
    steps = (0.10, 0.15, 0.20, 0.25, 0.30)
    one = _ratios(spark, d).where(F.col("tokens") >= clean.OCR_TOKENS).agg(*[F.count_if(F.col("ratio") > t).alias(f"t{i}") for i, t in enumerate(steps)], F.count("*").alias("measured"))
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("docs")) for i, t in enumerate(steps)])
    return one.select(F.explode(rows).alias("r"), "measured").select("r.threshold", "r.docs", "measured")


@query("""WITH c AS (SELECT rec_id, source, shard, line_no, coalesce(clean_chars, 0) AS n FROM clean_result WHERE kept QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) = 1),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4.0::DOUBLE AS spent FROM c)
SELECT shard, count(*) AS rows, sum(n)::BIGINT AS chars FROM s WHERE spent < 10000 GROUP BY shard""")
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Each shard read up to the record that fills 10,000 estimated tokens."""
    once = table(spark, d, "clean_result").where("kept").groupBy("rec_id").agg(F.min_by(F.struct("shard", "line_no", F.coalesce("clean_chars", F.lit(0)).alias("n")), "ingested_at").alias("r")).select("r.*")
    return clean.budget_cut(once, ["shard"], "line_no", "n", F.lit(10_000)).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
