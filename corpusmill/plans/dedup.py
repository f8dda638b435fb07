"""Queries of duplicates, contamination and each document's fate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dedup
from corpusmill.plans.registry import query
from corpusmill.sources.tables import spread, table

#: Sources whose duplicates and contamination are looked for (the first rule is for court texts, the second also for filings).
NEAR_SOURCES, BAD_SOURCES = "case-law", "case-law|sec"
_NORM = rf"trim(regexp_replace(lower(coalesce(text, '')), '{T.SPACE_SQL}+', ' ', 'g'))"
_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _grams(n: int, w: str = "w") -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i+{n - 1}], ' ')) ELSE [] END"


_BENCH = f"bench AS (SELECT DISTINCT unnest({_grams(13)}) AS gram FROM (SELECT {_W} AS w FROM benchmark))"
_BAD = f"""{_BENCH}, dg AS (SELECT doc_id, source, unnest({_grams(13)}) AS gram FROM (SELECT doc_id, source, {_W} AS w FROM documents)),
bad AS (SELECT DISTINCT doc_id FROM dg SEMI JOIN bench USING (gram))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return dedup.gram_set(table(spark, d, "benchmark"), "text")


@query(f"SELECT source, count(*) AS docs, count(DISTINCT {_NORM}) AS texts FROM documents GROUP BY source")
def exact_dup_report(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct(dedup.same_text(F.col("text"))).alias("texts"))


@query(f"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, {_NORM}")
def exact_dup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text in its shard (here, its source)."""
    return dedup.first_of(_docs(spark, d).select("source", "doc_id", dedup.same_text(F.col("text")).alias("h")), [F.col("source"), F.col("h")], [F.col("doc_id")]).select("source", "doc_id")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE {_NORM} <> '' GROUP BY {_NORM} HAVING count(*) > 1")
def exact_dup_global(spark: SparkSession, d: str) -> DataFrame:
    """Texts with copies anywhere in the corpus."""
    n = _docs(spark, d).where(T.normalize(T.text_of(F.col("text"))) != "")
    return n.groupBy(dedup.same_text(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query(f"WITH {_BENCH} SELECT gram FROM bench")
def contamination_grams(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d)


@query(f"WITH {_BAD} SELECT doc_id FROM bad")
def contaminated_docs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.holding(_docs(spark, d), "doc_id", "text", _held(spark, d))


@query(f"WITH {_BAD} SELECT doc_id, source FROM documents d WHERE NOT (regexp_matches(source, '^({BAD_SOURCES})') AND doc_id IN (SELECT doc_id FROM bad))")
def decontaminated(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after the anti-join; only some sources are looked at."""
    docs = _docs(spark, d)
    bad = dedup.holding(docs.where(F.col("source").rlike(f"^({BAD_SOURCES})")), "doc_id", "text", _held(spark, d))
    return docs.join(bad, "doc_id", "left_anti").select("doc_id", "source")


_SETS = f"""t AS (SELECT array_to_string({_W}, ' ') AS t, min(doc_id) AS k FROM documents WHERE len({_W}) > 0 GROUP BY 1),
sets AS (SELECT k, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_grams(5)} END) AS s FROM (SELECT k, string_split(t, ' ') AS w FROM t)),
sg AS (SELECT k, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.k AS a, b.k AS b, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity FROM sg a JOIN sg b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k HAVING round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) >= 0.8)"""


@query(f"WITH {_SETS} SELECT a, b, similarity FROM pairs")
def shingle_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts at least 0.8 alike; the smallest id stands for equal texts."""
    return dedup.jaccard_pairs(_docs(spark, d), "doc_id", "text")


@query(f"""WITH RECURSIVE {_SETS},
nodes AS (SELECT a AS v FROM pairs UNION SELECT b FROM pairs), ranked AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM nodes),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT r.i, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = r.v AND list_contains(w.kept, p.a)) THEN w.kept ELSE list_append(w.kept, r.v) END FROM walk w JOIN ranked r ON r.i = w.i + 1)
SELECT v AS doc_id FROM nodes WHERE NOT list_contains((SELECT kept FROM walk ORDER BY i DESC LIMIT 1), v)""")
def near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a pass in order of ids drops as near duplicates of kept ones."""
    e = dedup.jaccard_pairs(_docs(spark, d), "doc_id", "text").select(F.col("a").alias("hi"), F.col("b").alias("lo"))
    return dedup.greedy_drop(e).select(F.col("lo").alias("doc_id"))


@query()
def minhash_lsh_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Court texts that the signature index drops; its hash family is Spark's, so no SQL gives the same rows."""
    court = _docs(spark, d).where(F.col("source").rlike(f"^({NEAR_SOURCES})"))
    return dedup.greedy_drop(dedup.lsh_pairs(dedup.signatures(court, "doc_id", "text"))).select(F.col("lo").alias("doc_id"))


#: Written from the sequential rule: court texts in order of ids, each compared with the kept ones before it, copies among them.
_FATE = rf"""{_BAD}, d AS (SELECT doc_id, source, text, {_NORM} AS h, {_W} AS w FROM documents WHERE length(text) > 0),
ct AS (SELECT doc_id AS v, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct({_grams(5)}) END AS s FROM d WHERE source LIKE 'case-law%'),
cg AS (SELECT v, len(s) AS n, unnest(s) AS g FROM ct),
alike AS (SELECT a.v AS a, b.v AS b FROM cg a JOIN cg b ON a.g = b.g AND a.v < b.v GROUP BY 1, 2 HAVING round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) >= 0.8 UNION ALL SELECT a.v, b.v FROM ct a JOIN ct b ON len(a.s) = 0 AND len(b.s) = 0 AND a.v < b.v),
turn AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT a AS v FROM alike UNION SELECT b FROM alike)),
pass AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT t.i, CASE WHEN EXISTS (SELECT 1 FROM alike x WHERE x.b = t.v AND list_contains(p.kept, x.a)) THEN p.kept ELSE list_append(p.kept, t.v) END FROM pass p JOIN turn t ON t.i = p.i + 1),
near AS (SELECT v AS doc_id FROM turn WHERE NOT list_contains((SELECT kept FROM pass ORDER BY i DESC LIMIT 1), v)),
left_ AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS n, doc_id IN (SELECT doc_id FROM bad) AND (source LIKE 'case-law%' OR source LIKE 'sec%') AS c FROM d WHERE doc_id NOT IN (SELECT doc_id FROM near)),
fate AS (SELECT doc_id, source, 'near_dup' AS fate FROM d WHERE doc_id IN (SELECT doc_id FROM near) UNION ALL SELECT doc_id, source, CASE WHEN c THEN 'contaminated' WHEN n > 1 THEN 'exact_dup' ELSE 'kept' END FROM left_)"""


def _fates(spark: SparkSession, d: str) -> DataFrame:
    scope = lambda names: F.col("source").rlike(f"^({names})")
    return dedup.fates(_docs(spark, d), "doc_id", "text", "source", _held(spark, d), scope(NEAR_SOURCES), scope(BAD_SOURCES))


@query(f"WITH RECURSIVE {_FATE} SELECT doc_id, source, fate FROM fate")
def corpus_disposition(spark: SparkSession, d: str) -> DataFrame:
    return _fates(spark, d)


@query(f"WITH RECURSIVE {_FATE} SELECT source, count(*) AS docs, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'near_dup') AS near_dup, count(*) FILTER (fate = 'exact_dup') AS exact_dup, count(*) FILTER (fate = 'contaminated') AS contaminated, coalesce(sum(length(text)) FILTER (fate = 'kept'), 0)::BIGINT // 4 AS est_tokens FROM fate JOIN documents USING (doc_id, source) GROUP BY source")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    is_ = lambda k: F.count_if(F.col("fate") == k).alias(k)
    tokens = T.proxy_tokens(F.coalesce(F.sum(F.when(F.col("fate") == "kept", F.col("chars"))), F.lit(0)))
    return _fates(spark, d).join(sizes, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), is_("kept"), is_("near_dup"), is_("exact_dup"), is_("contaminated"), tokens.alias("est_tokens"))


@query(f"WITH RECURSIVE {_FATE}, n AS (SELECT count(*) AS docs, count(*) FILTER (fate <> 'near_dup') AS a, count(*) FILTER (fate NOT IN ('near_dup', 'contaminated')) AS b, count(*) FILTER (fate = 'kept') AS c FROM fate) SELECT * FROM (SELECT 1 AS step, 'near_dup' AS stage, docs AS rows_in, a AS rows_out FROM n UNION ALL SELECT 2, 'contaminated', a, b FROM n UNION ALL SELECT 3, 'exact_dup', b, c FROM n)")
def attrition(spark: SparkSession, d: str) -> DataFrame:
    """Rows in and out of each stage, of one aggregation."""
    f = F.col("fate")
    n = _fates(spark, d).agg(F.count("*").alias("n0"), F.count_if(f != "near_dup").alias("n1"), F.count_if(~f.isin("near_dup", "contaminated")).alias("n2"), F.count_if(f == "kept").alias("n3"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(f"n{i}").alias("rows_in"), F.col(f"n{i + 1}").alias("rows_out")) for i, s in enumerate(("near_dup", "contaminated", "exact_dup"))])
    return n.select(F.inline(rows))


@query(f"""WITH RECURSIVE {_SETS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT k AS x, k AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
root AS (SELECT x AS k, min(y) AS root FROM reach GROUP BY x), copies AS (SELECT min(doc_id) AS k, count(*) AS n FROM documents WHERE len({_W}) > 0 GROUP BY array_to_string({_W}, ' ')),
m AS (SELECT root, sum(n)::DOUBLE AS m FROM copies JOIN root USING (k) GROUP BY root) SELECT count(*) AS groups, sum(m)::BIGINT AS docs, round(sum(m) * sum(m) / sum(m * m), 6) AS effective FROM m""")
def effective_diversity(spark: SparkSession, d: str) -> DataFrame:
    """The number of equally large clusters of near duplicates that would be as diverse."""
    docs = _docs(spark, d)
    words = F.array_join(T.words(T.text_of(F.col("text"))), " ")
    copies = docs.select("doc_id", words.alias("t")).where("t != ''").groupBy("t").agg(F.min("doc_id").alias("k"), F.count("*").alias("n")).select("k", "n")
    of = copies.join(dedup.clusters(dedup.jaccard_pairs(docs, "doc_id", "text")), "k", "left")
    m = of.groupBy(F.coalesce("root", "k").alias("root")).agg(F.sum("n").cast("double").alias("m"))
    return m.agg(F.count("*").alias("groups"), F.sum("m").cast("bigint").alias("docs"), F.round(F.sum("m") * F.sum("m") / F.sum(F.col("m") * F.col("m")), 6).alias("effective"))


@query(rf"SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents) GROUP BY w")
def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs, the table a vocabulary is learnt from."""
    return _docs(spark, d).select(F.explode(T.words(T.text_of(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH g AS (SELECT source, unnest({_grams(4)}) AS gram FROM (SELECT source, {_W} AS w FROM documents)), c AS (SELECT source, gram, count(*) AS n FROM g GROUP BY source, gram) SELECT source, gram, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, gram) <= 10")
def top_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """The ten commonest 4-grams of each source; ties by the gram."""
    from pyspark.sql import Window

    g = _docs(spark, d).select("source", F.explode(T.grams(T.words(T.text_of(F.col("text"))), 4)).alias("gram")).groupBy("source", "gram").agg(F.count("*").alias("n"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "gram"))).where("_r <= 10").drop("_r")
