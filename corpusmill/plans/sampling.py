"""Queries of samples, orders, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import curate
from corpusmill.operators.order import ranked
from corpusmill.plans.cleaning import head_of
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clean_result").select("source", "shard", "line_no").distinct()


@query("SELECT DISTINCT shard, line_no FROM clean_result WHERE line_no % 20 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("line_no % 20 = 0").select("shard", "line_no")


@query("SELECT line_no % 12 AS part, count(*) AS lines FROM (SELECT DISTINCT shard, line_no FROM clean_result) GROUP BY 1")
def stride_shard(spark: SparkSession, d: str) -> DataFrame:
    """Lines dealt to twelve workers by their index in the file."""
    return _records(spark, d).groupBy((F.col("line_no") % 12).alias("part")).agg(F.count("*").alias("lines"))


_U = "(('0x' || substring(md5('3:' || shard || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH n AS (SELECT shard, max(line_no) + 1 AS n FROM clean_result GROUP BY shard), i AS (SELECT shard, n, unnest(range(0, 8)) AS i FROM n WHERE n > 8), p AS (SELECT DISTINCT shard, least(n - 1, floor(i * (n / 8.0::DOUBLE) + {_U} * (n / 8.0::DOUBLE)))::BIGINT AS line_no FROM i) SELECT * FROM p UNION ALL SELECT shard, unnest(range(0, n))::BIGINT FROM n WHERE n <= 8")
def jittered_sample(spark: SparkSession, d: str) -> DataFrame:
    """Eight lines spread over each shard, with jitter from a hash; all of a shard with fewer."""
    n = table(spark, d, "clean_result").groupBy("shard").agg((F.max("line_no") + 1).cast("bigint").alias("n"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("3:"), "shard", F.lit(":"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    stride = F.col("n") / F.lit(8.0)
    some = n.where("n > 8").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    picks = some.select("shard", F.least(F.col("n") - 1, F.floor(F.col("i") * stride + u * stride)).alias("line_no")).distinct()
    return picks.unionByName(n.where("n <= 8").select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("line_no")))


@query("WITH s AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, shard FROM clean_result)) SELECT source, shard, (100 // n + CASE WHEN i < 100 % n THEN 1 ELSE 0 END)::BIGINT AS quota FROM s")
def plan_shards(spark: SparkSession, d: str) -> DataFrame:
    """A source's quota of 100 dealt to its shards, the first ones taking the rest."""
    s = table(spark, d, "clean_result").select("source", "shard").distinct()
    i, n = F.row_number().over(Window.partitionBy("source").orderBy("shard")) - 1, F.count("*").over(Window.partitionBy("source"))
    s = s.select("source", "shard", i.alias("i"), n.alias("n"))
    return s.select("source", "shard", (F.floor(F.lit(100) / F.col("n")) + (F.col("i") < 100 % F.col("n")).cast("int")).cast("bigint").alias("quota"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents in a reproducible order: a top-k, merged from each task's fifty."""
    return table(spark, d, "documents").select("doc_id").orderBy(curate.shuffled("42", F.col("doc_id")), "doc_id").limit(50)


@query("SELECT type, id FROM (SELECT DISTINCT type, id FROM candidate) WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type ORDER BY md5('0:' || id), id) <= 20")
def per_type_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate").select("type", "id").where("type IS NOT NULL").distinct()
    return c.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy(curate.shuffled("0", F.col("id")), "id"))).where("n <= 20").drop("n")


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents), p AS (SELECT DISTINCT source, CASE WHEN n = 1 THEN 0 ELSE floor(k * (n - 1) / (least(5, n) - 1)::DOUBLE) END::BIGINT AS i FROM n, LATERAL (SELECT unnest(range(0, least(5, n))) AS k)) SELECT source, doc_id FROM r JOIN p USING (source, i)")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents evenly spaced over each source, the first and the last among them."""
    r = ranked(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "i")
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(5), F.col("n")) - 1))
    p = n.withColumn("k", k).select("source", F.when(F.col("n") == 1, 0).otherwise(F.floor(F.col("k") * (F.col("n") - 1) / (F.least(F.lit(5), F.col("n")) - 1).cast("double"))).cast("bigint").alias("i")).distinct()
    return r.join(p, ["source", "i"]).select("source", "doc_id")


@query("SELECT source, doc_id, row_number() OVER (ORDER BY md5('1337:2:' || doc_id), doc_id) - 1 AS place FROM documents")
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """All documents, as windows of a corpus, in the order of epoch 2."""
    docs = table(spark, d, "documents").select("source", "doc_id", curate.shuffled("1337:2", F.col("doc_id")).alias("h"))
    return ranked(docs, [], ["h", "doc_id"]).drop("h")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 8 = 3")
def rank_shard(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth document, from the fourth: one worker's share."""
    return ranked(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "i").where("i % 8 = 3").drop("i")


@query("SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, md5('7:' || id), id) AS place FROM (SELECT DISTINCT id, source, coalesce(llm_judge_score, 0) AS score FROM candidate)")
def score_order(spark: SparkSession, d: str) -> DataFrame:
    """Best first within a source, ties in a reproducible order."""
    c = table(spark, d, "candidate").select("id", "source", F.coalesce("llm_judge_score", F.lit(0)).alias("score")).distinct()
    c = c.withColumn("h", curate.shuffled("7", F.col("id")))
    return ranked(c, ["source"], [F.desc("score"), "h", "id"]).select("id", (F.col("place") + 1).alias("place"))


@query("SELECT source, sum(length(text))::BIGINT AS chars, round(sum(length(text))::DOUBLE / sum(sum(length(text))) OVER (), 6) AS share FROM documents WHERE text IS NOT NULL GROUP BY source")
def char_share(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share of all characters."""
    g = table(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return g.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy(F.lit(1))), 6))


@query("SELECT name FROM source_config EXCEPT SELECT DISTINCT source FROM (SELECT source FROM documents WHERE lang = 'ru')")
def sources_without(spark: SparkSession, d: str) -> DataFrame:
    """Sources without a Russian document: a set difference as an anti-join."""
    ru = table(spark, d, "documents").where("lang = 'ru'").select(F.col("source").alias("name")).distinct()
    return table(spark, d, "source_config").select("name").join(ru, "name", "left_anti")


@query("SELECT count(*) AS only_left, (SELECT count(*) FROM (SELECT source FROM clean_result EXCEPT SELECT name FROM source_config)) AS only_right FROM (SELECT name FROM source_config EXCEPT SELECT source FROM clean_result)")
def same_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Whether two sets are equal: what each has alone, in one full join."""
    a = table(spark, d, "source_config").select(F.col("name").alias("v")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "clean_result").select(F.col("source").alias("v")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "v", "full").agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query("SELECT coalesce(n.source, o.source) AS source, coalesce(n.docs, o.docs) AS docs, n.docs IS NOT NULL AS updated FROM (SELECT source, count(*) AS docs FROM clean_result GROUP BY source) o FULL JOIN (SELECT source, count(*) AS docs FROM documents WHERE lang = 'de' GROUP BY source) n USING (source)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """New figures where there are some, else the old ones."""
    o = table(spark, d, "clean_result").groupBy("source").agg(F.count("*").alias("o"))
    n = table(spark, d, "documents").where("lang = 'de'").groupBy("source").agg(F.count("*").alias("n"))
    return o.join(n, "source", "full").select("source", F.coalesce("n", "o").alias("docs"), F.col("n").isNotNull().alias("updated"))


@query(r"SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['orchard', 'lens', 'debenture'])")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold one of some words: a non-empty intersection of sets."""
    return table(spark, d, "documents").where(F.arrays_overlap(T.words(T.text_of(F.col("text"))), F.array(F.lit("orchard"), F.lit("lens"), F.lit("debenture")))).select("doc_id")


@query("SELECT id, b.item_id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS i FROM (SELECT DISTINCT id, source FROM passage)) p JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS j, count(*) OVER () AS n FROM benchmark) b ON p.i % b.n = b.j")
def wrap_around(spark: SparkSession, d: str) -> DataFrame:
    """Row i takes item i modulo their number; items are the fixed held-out set."""
    p = ranked(table(spark, d, "passage").select("id", "source").distinct(), ["source"], ["id"], "i").select("id", "i")
    b = ranked(table(spark, d, "benchmark").select("item_id"), [], ["item_id"], "j")
    n = max(1, b.count())
    return p.withColumn("j", F.col("i") % n).join(b, "j").select("id", "item_id")


_TAKEN = """n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
k AS (SELECT source, n, least(n, 16) AS m FROM n), e AS (SELECT source, n, m, unnest(range(0, m)) AS j FROM k),
p AS (SELECT DISTINCT source, CASE WHEN m = n THEN j ELSE least(n - 1, floor(j * (n / m::DOUBLE) + (('0x' || substring(md5('9:' || source || ':' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (n / m::DOUBLE))) END::BIGINT AS i FROM e)"""


@query(rf"WITH {_TAKEN}, ok AS (SELECT source, doc_id, i FROM r JOIN p USING (source, i) WHERE length(trim(regexp_replace(coalesce(text, ''), '{T.SPACE_SQL}+', ' ', 'g'))) >= 500 AND len(string_split(trim(regexp_replace(coalesce(text, ''), '{T.SPACE_SQL}+', ' ', 'g')), ' ')) >= 120) SELECT source, doc_id FROM ok QUALIFY row_number() OVER (PARTITION BY source ORDER BY i) <= 10")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten passages of each source: 1.6 times as many lines are looked at, in order, and the first ten that make a passage are taken."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    n = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("m", F.least("n", F.lit(16)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("9:"), "source", F.lit(":"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    stride = F.col("n") / F.col("m")
    at = F.when(F.col("m") == F.col("n"), F.col("j")).otherwise(F.least(F.col("n") - 1, F.floor(F.col("j") * stride + u * stride)))
    picks = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).select("source", at.alias("i")).distinct()
    looked = ranked(docs.select("source", "doc_id"), ["source"], ["doc_id"], "i").join(picks, ["source", "i"]).join(docs.select("doc_id", "text"), "doc_id")
    p = curate.passage(F.col("text"))
    ok = looked.where(p.isNotNull() & (F.size(F.split(p, " ")) >= curate.PASSAGE_LEAST))
    return head_of(ok, "source", "i", 10).select("source", "doc_id")


@query("""WITH q AS (SELECT source, least(50, count(*)) AS q FROM documents GROUP BY source), x AS (SELECT source, q, type, pos, q * share AS x FROM q, (VALUES ('lookup', 0.5::DOUBLE, 0), ('reasoning', 0.3::DOUBLE, 1), ('unanswerable', 0.2::DOUBLE, 2)) v(type, share, pos)),
c AS (SELECT source, type, pos, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY x - floor(x) DESC, pos) <= q - sum(floor(x)) OVER (PARTITION BY source) THEN 1 ELSE 0 END)::BIGINT AS n FROM x),
s AS (SELECT source, type, pos, unnest(range(0, n)) AS j FROM c) SELECT source, type, row_number() OVER (PARTITION BY source ORDER BY md5('13:' || source || ':' || type || ':' || j)) - 1 AS at FROM s""")
def type_sequence(spark: SparkSession, d: str) -> DataFrame:
    """A shuffled sequence of question types for each source's quota, exactly in the shares of the mix."""
    q = table(spark, d, "documents").groupBy("source").agg(F.least(F.lit(50), F.count("*")).alias("q"))
    kinds = F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("share"), F.lit(i).alias("pos")) for i, (t, x) in enumerate(curate.TYPE_MIX.items())]))
    parts = curate.allocate(q.select("source", "q", kinds), "share", "pos", F.col("q"), ["source"])
    seq = parts.where("quota > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)))
    h = F.md5(F.concat(F.lit("13:"), "source", F.lit(":"), "type", F.lit(":"), F.col("j").cast("string")))
    return ranked(seq.select("source", "type", h.alias("h")), ["source"], ["h"], "at").drop("h")


@query("WITH g AS (SELECT source, sum(length(text))::DOUBLE AS c FROM documents WHERE text IS NOT NULL GROUP BY source) SELECT row_number() OVER (ORDER BY round(c / (SELECT sum(c) FROM g), 6) DESC, source) - 1 AS place, source, round(c / (SELECT sum(c) FROM g), 6) AS share FROM g")
def mix_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The mix in order of its shares, ties by name, each with its place."""
    return ranked(char_share(spark, d).select("source", "share"), [], [F.desc("share"), "source"])
