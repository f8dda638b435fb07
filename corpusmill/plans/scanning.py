"""Queries of sources and of simple projections and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans.cleaning import head_of
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table


@query("SELECT count(*) AS docs, count(text) AS texts, sum(length(text))::BIGINT AS chars FROM documents")
def scan_text(spark: SparkSession, d: str) -> DataFrame:
    """One column of the corpus; the scan reads no other."""
    return table(spark, d, "documents").select("text").agg(F.count("*").alias("docs"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents of each source."""
    return head_of(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query("SELECT shard, source, count(DISTINCT line_no) AS lines, max(line_no)::BIGINT AS last FROM clean_result GROUP BY shard, source")
def shard_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clean_result").groupBy("shard", "source").agg(F.count_distinct("line_no").alias("lines"), F.max("line_no").cast("bigint").alias("last"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM s)
SELECT doc_id, line_no::INT AS line_no, length(line)::BIGINT AS chars FROM e WHERE trim(line) <> ''""")
def line_index(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their index; blank lines are left out but counted."""
    e = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return e.where(F.trim("line") != "").select("doc_id", "line_no", F.length("line").cast("bigint").alias("chars"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS breaks FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line breaks, so that an unterminated last line isn't counted."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("breaks"))


@query("SELECT source, count(*) AS docs, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, max(length(text))::BIGINT AS longest FROM documents GROUP BY source")
def size_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("SELECT DISTINCT c.shard, c.line_no, md5(coalesce(c.text, '')) AS hash FROM clean_result c SEMI JOIN (SELECT source || '-' || replace(source_file, '.txt', '') AS f, line_no FROM passage) p ON replace(c.shard, c.source || '-', c.source || '-shard-') = p.f AND c.line_no = p.line_no")
def pick_lines(spark: SparkSession, d: str) -> DataFrame:
    """The records at the lines that passages name: a random-access read as a semi-join."""
    p = table(spark, d, "passage").select(F.concat("source", F.lit("-"), F.replace("source_file", F.lit(".txt"), F.lit(""))).alias("f"), "line_no").distinct()
    c = table(spark, d, "clean_result").withColumn("f", F.replace("shard", F.concat("source", F.lit("-")), F.concat("source", F.lit("-shard-"))))
    return c.join(p, ["f", "line_no"], "left_semi").select("shard", "line_no", F.md5(F.coalesce("text", F.lit(""))).alias("hash")).distinct()


@query(rf"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(10), ' '), '{T.SPACE_SQL}+', ' ', 'g'))) AS hash FROM documents WHERE text IS NOT NULL")
def one_line_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the line-oriented sink writes them."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("hash"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON rows by a declared schema; nothing is inferred."""
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT d.doc_id, s.hf_id, s.text_field, coalesce(s.strict_ocr, false) AS strict_ocr FROM documents d JOIN source_config s ON d.source = s.name")
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each document's source settings; the planner broadcasts the settings by their size on disk."""
    s = table(spark, d, "source_config").select(F.col("name").alias("source"), "hf_id", "text_field", F.coalesce("strict_ocr", F.lit(False)).alias("strict_ocr"))
    return table(spark, d, "documents").select("doc_id", "source").join(s, "source").select("doc_id", "hf_id", "text_field", "strict_ocr")


@query("SELECT item_id, md5(concat_ws(' ', dataset, text)) AS hash FROM benchmark")
def all_strings(spark: SparkSession, d: str) -> DataFrame:
    """All string columns of a row as one text, whatever they are called."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.md5(F.concat_ws(" ", *[c for c, t in b.dtypes if t == "string"])).alias("hash"))


@query("SELECT id, substring(context, 1, 2400) IS NOT NULL AS has, length(substring(context, 1, 2400))::BIGINT AS chars, substring(question, 1, 160) AS excerpt FROM candidate")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").select("id", F.substring("context", 1, 2400).isNotNull().alias("has"), F.length(F.substring("context", 1, 2400)).cast("bigint").alias("chars"), F.substring("question", 1, 160).alias("excerpt"))


@query("SELECT event_id, greatest(1, least(50, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE floor(value * 3)::INT::VARCHAR END AS INT), 10)))::INT AS k FROM events")
def clamp(spark: SparkSession, d: str) -> DataFrame:
    """Values coerced and held between bounds; what can't be coerced takes the default."""
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.floor(F.col("value") * 3).cast("int").cast("string"))
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(raw.try_cast("int"), F.lit(10)))).alias("k"))


@query("SELECT step, CASE WHEN step < 100 THEN 0.0006 * (step + 1) / 100 ELSE 0.00006 + 0.5 * (0.0006 - 0.00006) * (1 + cos(pi() * (step - 100) / 900)) END::DOUBLE AS lr FROM (SELECT unnest(range(0, 1000))::BIGINT AS step)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up, then a half cosine."""
    s = F.col("step")
    lr = F.when(s < 100, 0.0006 * (s + 1) / 100).otherwise(0.00006 + 0.5 * (0.0006 - 0.00006) * (1 + F.cos(F.pi() * (s - 100) / 900)))
    return spark.range(1000).select(F.col("id").alias("step")).select("step", lr.alias("lr"))


@query("SELECT build_id, sum(train_windows)::BIGINT AS windows, (sum(train_windows) // 512)::BIGINT AS steps_per_epoch, (sum(train_windows) // 512 * 4)::BIGINT AS total_steps, (sum(train_windows) // 512 * 4 * 524288)::BIGINT AS tokens_seen FROM token_index GROUP BY build_id")
def step_plan(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "token_index").groupBy("build_id").agg(F.sum("train_windows").alias("windows"))
    per = F.floor(F.col("windows") / 512)
    return g.select("build_id", "windows", per.alias("steps_per_epoch"), (per * 4).alias("total_steps"), (per * 4 * 524288).alias("tokens_seen"))


@query(r"SELECT doc_id, CASE WHEN len(w) = 0 THEN ['<bos>'] ELSE w[greatest(1, len(w) - 15):] END AS last FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)")
def last_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The last 16 tokens of each text; an empty text gives the start token."""
    w = T.words(T.text_of(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.when(F.size(w) == 0, F.array(F.lit("<bos>"))).otherwise(F.slice(w, F.greatest(F.lit(1), F.size(w) - 15), 16)).alias("last"))
