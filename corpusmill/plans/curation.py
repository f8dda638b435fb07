"""Queries of instruction pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import tokens
from corpusmill.operators import curate, dedup
from corpusmill.operators.order import ranked
from corpusmill.plans.registry import query
from corpusmill.sources.tables import spread, table

_WS = T.SPACE_SQL
_COL = rf"trim(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g'))"


def _form(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '{_WS}+', ' ', 'g'))"


#: One row of each candidate id.
_ONCE = "once AS (SELECT DISTINCT id, source, type, question, answer, context, context_tokens, llm_judge_score AS score, llm_judge_verdict AS verdict, llm_judge_reason AS why, drop_reason FROM candidate)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").select("id", "source", "type", "question", "answer", "context", "context_tokens", F.col("llm_judge_score").alias("score"), F.col("llm_judge_verdict").alias("verdict"), F.col("llm_judge_reason").alias("why"), "drop_reason").distinct()


@query(rf"""WITH t AS (SELECT doc_id, source, {_COL} AS t FROM documents), w AS (SELECT doc_id, source, string_split(t, ' ') AS w, t FROM t WHERE length(t) >= 500),
c AS (SELECT *, array_to_string(w[1:700], ' ') AS whole FROM w), e AS (SELECT *, regexp_extract(whole, '(?s)^(.*[.!?])\s', 1) AS ended FROM c),
p AS (SELECT doc_id, source, CASE WHEN len(w) <= 700 THEN t WHEN ended <> '' AND length(ended) >= 0.5 * length(whole) THEN ended ELSE whole END AS p FROM e)
SELECT source || '-' || lpad(doc_id::VARCHAR, 7, '0') AS id, length(p)::BIGINT AS chars, len(string_split(p, ' '))::BIGINT AS n_tokens, md5(p) AS hash FROM p WHERE len(string_split(p, ' ')) >= 120""")
def build_passages(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", curate.passage(F.col("text")).alias("p")).where("p IS NOT NULL")
    n = F.size(F.split("p", " ")).cast("bigint")
    return p.select(F.concat("source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"), F.length("p").cast("bigint").alias("chars"), n.alias("n_tokens"), F.md5("p").alias("hash")).where(F.col("n_tokens") >= curate.PASSAGE_LEAST)


@query()
def token_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of at most 700 and at least 120 tokens of a public vocabulary, cut at a sentence's end; no SQL encodes."""
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    t = T.collapse(T.text_of(F.col("text")))
    long = docs.select(F.concat("source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"), t.alias("t")).where(F.length("t") >= curate.PASSAGE_CHARS)
    return tokens.truncated(long, "id", "t", tokens.VOCABULARY, curate.PASSAGE_TOKENS).where(F.col("n_tokens") >= curate.PASSAGE_LEAST)


@query()
def token_examples(spark: SparkSession, d: str) -> DataFrame:
    """Rendered pairs as ids of a public vocabulary in rows of 1,024 with their masks; longer ones are left out."""
    r = spread(_once(spark, d)).select("id", curate.prompt(F.col("question"), F.col("context")).alias("p"), F.concat(T.text_of(F.col("answer")), F.lit("<|eos|>")).alias("c"))
    e = tokens.examples(r, "id", "p", "c", tokens.VOCABULARY, 1024).where("ids IS NOT NULL")
    n = F.size("ids")
    return e.select("id", curate.padded(F.slice("ids", 1, F.col("boundary")), F.slice("ids", F.col("boundary") + 1, n - F.col("boundary")), 1024).alias("r")).select("id", "r.*")


_STRIP = lambda c: rf"regexp_replace(coalesce({c}, ''), '^{_WS}+|{_WS}+$', '', 'g')"
_FAULT = rf"""CASE WHEN q = '' OR a = '' THEN 'empty_field' WHEN length(q) < 15 THEN 'question_too_short' WHEN NOT contains(q, '?') THEN 'not_a_question'
 WHEN regexp_matches(q, '(?i){curate.CONTEXT_LEAK}') THEN 'context_leak_in_question' WHEN regexp_matches(a, '{curate.BROKEN_OFF}') THEN 'answer_truncated'
 WHEN coalesce(type, '') = 'unanswerable' AND {_form('a')} <> 'the provided context does not say' THEN 'refusal_text_wrong' WHEN coalesce(type, '') = 'unanswerable' THEN NULL
 WHEN length(a) < 20 THEN 'answer_too_short' WHEN len(list_filter(regexp_split_to_array(a, '{_WS}+'), lambda w: w <> '')) > 150 THEN 'answer_too_long' WHEN {_form('a')} = 'the provided context does not say' THEN 'unexpected_refusal' END"""


@query(f"WITH {_ONCE} SELECT id, {_FAULT} AS fault FROM (SELECT id, type, {_STRIP('question')} AS q, {_STRIP('answer')} AS a FROM once)")
def validate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d).select("id", curate.format_fault(F.col("type"), F.col("question"), F.col("answer")).alias("fault"))


@query("SELECT event_id, k FROM (SELECT event_id, TRY_CAST(regexp_replace(regexp_replace(reply, '^```(json)?\\s*', ''), '\\s*```$', '') AS JSON) AS j FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props ELSE 'no ' || props END AS reply FROM events)), LATERAL (SELECT (j->>'$.k')::BIGINT AS k) WHERE k IS NOT NULL")
def parse_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that may be fenced; those that are no JSON object are left out."""
    e = F.col("event_id") % 3
    reply = F.when(e == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e == 1, F.col("props")).otherwise(F.concat(F.lit("no "), "props"))
    bare = F.regexp_replace(F.regexp_replace(reply, r"^```(json)?\s*", ""), r"\s*```$", "")
    return table(spark, d, "events").select("event_id", F.from_json(bare, "k bigint")["k"].alias("k")).where("k IS NOT NULL")


@query(f"WITH {_ONCE} SELECT id, md5('<|bos|><|system|>' || 'You are a legal and financial assistant.' || chr(10) || 'Answer only from the provided context.' || chr(10) || 'If the context is not enough, say you do not know.' || '<|user|>Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || '<|assistant|>') AS prompt, coalesce(answer, '') || '<|eos|>' AS completion FROM once")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d).select("id", F.md5(curate.prompt(F.col("question"), F.col("context"))).alias("prompt"), F.concat(T.text_of(F.col("answer")), F.lit("<|eos|>")).alias("completion"))


_REFUSED = "(" + " OR ".join(f"contains(lower(coalesce(answer, '')), '{m}')" for m in curate.REFUSAL_MARKS) + ")"


@query(f"WITH {_ONCE} SELECT id, {_REFUSED} AS refused FROM once")
def refusal_flag(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d).select("id", curate.is_refusal(F.col("answer")).alias("refused"))


_MARKS = f"SELECT id, source, type, question, answer, coalesce(score, 0) AS s, coalesce(why <> 'adds a claim', false) AS g, contains(coalesce(question, ''), '?') AS r, (coalesce(type, '') <> 'unanswerable' OR {_REFUSED}) AS o FROM once"
_JUDGED = f"marks AS ({_MARKS}), judged AS (SELECT *, CASE WHEN s < 4 THEN 'judge_score' WHEN NOT g THEN 'judge_ungrounded' WHEN NOT r THEN 'judge_not_a_question' WHEN NOT o THEN 'judge_refusal_wrong' END AS reason FROM marks)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    c = _once(spark, d)
    ok = (F.coalesce("type", F.lit("")) != "unanswerable") | curate.is_refusal(F.col("answer"))
    verdict, why = curate.judged(F.col("score"), F.col("why") != "adds a claim", F.contains(T.text_of(F.col("question")), F.lit("?")), ok)
    return c.select("id", "source", "type", "question", "answer", F.coalesce("score", F.lit(0)).alias("s"), verdict.alias("verdict"), why.alias("reason"))


@query(f"WITH {_ONCE}, {_JUDGED} SELECT id, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS verdict, reason FROM judged")
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts recomputed from the marks, fail-closed."""
    return _judged(spark, d).select("id", "verdict", "reason")


@query(f"""WITH {_ONCE}, items AS (SELECT id, source, (row_number() OVER (PARTITION BY source ORDER BY id) - 1) AS n FROM once), results AS (SELECT i.source, i.n, score, 1 AS pos FROM items i JOIN once o USING (id) WHERE score IS NOT NULL UNION ALL SELECT source, n, 1, 2 FROM items WHERE n % 5 = 0),
last AS (SELECT source, n // 8 AS batch, n % 8 AS idx, arg_max(score, pos) AS score FROM results GROUP BY 1, 2, 3)
SELECT i.id, i.n // 8 AS batch, i.n % 8 AS idx, coalesce(l.score, 0)::INT AS score, CASE WHEN l.score IS NULL THEN 'judge_missing_result' END AS reason FROM items i LEFT JOIN last l ON l.source = i.source AND l.batch = i.n // 8 AND l.idx = i.n % 8""")
def judge_join(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight joined with results by index: a later duplicate wins, a missing one fails."""
    items = ranked(_once(spark, d).select("id", "source", "score"), ["source"], ["id"], "n")
    results = items.where("score IS NOT NULL").select("source", "n", "score", F.lit(1).alias("pos")).unionByName(items.where("n % 5 = 0").select("source", "n", F.lit(1).alias("score"), F.lit(2).alias("pos")))
    key = [F.floor(F.col("n") / 8).alias("batch"), (F.col("n") % 8).alias("idx")]
    last = results.groupBy("source", *key).agg(F.max_by("score", "pos").alias("result"))
    return items.select("id", "source", *key).join(last, ["source", "batch", "idx"], "left").select("id", "batch", "idx", F.coalesce("result", F.lit(0)).alias("score"), F.when(F.col("result").isNull(), "judge_missing_result").alias("reason"))


@query(f"WITH {_ONCE} SELECT min(id) AS id, count(*) AS copies FROM once GROUP BY {_form('question')}")
def question_dups(spark: SparkSession, d: str) -> DataFrame:
    """Questions of one form; the first id stands for them."""
    return _once(spark, d).groupBy(F.sha1(T.question_form(T.text_of(F.col("question")))).alias("h")).agg(F.min("id").alias("id"), F.count("*").alias("copies")).drop("h")


@query(f"WITH {_ONCE} SELECT min(id) AS id, count(*) AS copies FROM once WHERE length(answer) > 80 GROUP BY {_form('answer')}")
def boilerplate_answers(spark: SparkSession, d: str) -> DataFrame:
    """Copies among long answers only (here 80 characters, as none has the rule's 200); short ones may well be equal."""
    return _once(spark, d).where(F.length("answer") > 80).groupBy(F.sha1(T.question_form(T.text_of(F.col("answer")))).alias("h")).agg(F.min("id").alias("id"), F.count("*").alias("copies")).drop("h")


_FUNNEL = f"""{_ONCE}, {_JUDGED}, q AS (SELECT *, row_number() OVER (PARTITION BY {_form('question')} ORDER BY s DESC, md5('7:' || id), id) AS n FROM judged WHERE reason IS NULL),
fun AS (SELECT id, source, type, question, s, 'judge_fail' AS fate FROM judged WHERE reason IS NOT NULL UNION ALL SELECT id, source, type, question, s, CASE WHEN n > 1 THEN 'exact_dup' ELSE 'kept' END FROM q)"""


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's fate; the best of each question by score, then by a reproducible order."""
    j = _judged(spark, d)
    good = j.where("reason IS NULL").withColumn("h", F.sha1(T.question_form(T.text_of(F.col("question")))))
    order = Window.partitionBy("h").orderBy(F.desc("s"), curate.shuffled("7", F.col("id")), "id")
    first = F.row_number().over(order) == 1
    cols = ["id", "source", "type", "question", "s", "fate"]
    return j.where("reason IS NOT NULL").withColumn("fate", F.lit("judge_fail")).select(cols).unionByName(good.withColumn("fate", F.when(first, "kept").otherwise("exact_dup")).select(cols))


@query(f"WITH {_FUNNEL} SELECT fate, count(*) AS pairs FROM fun GROUP BY fate")
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d).groupBy("fate").agg(F.count("*").alias("pairs"))


@query(f"WITH {_FUNNEL} SELECT source, count(*) AS pairs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 3) AS share FROM fun WHERE fate = 'kept' GROUP BY source")
def mix_shares(spark: SparkSession, d: str) -> DataFrame:
    n = _funnel(spark, d).where("fate = 'kept'").groupBy("source").agg(F.count("*").alias("pairs"))
    return n.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy(F.lit(1))), 3))


@query(f"WITH {_FUNNEL} SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('11:' || id), id) <= 200 THEN 'eval' ELSE 'train' END AS split FROM fun WHERE fate = 'kept'")
def eval_split(spark: SparkSession, d: str) -> DataFrame:
    """200 pairs in a reproducible order are held out. They are found as a top-k, so no window sorts the whole set."""
    kept = _funnel(spark, d).where("fate = 'kept'").select("id")
    first = kept.orderBy(curate.shuffled("11", F.col("id")), "id").limit(200).withColumn("e", F.lit(True))
    return kept.join(first, "id", "left").select("id", F.when(F.col("e"), "eval").otherwise("train").alias("split"))


@query(f"WITH {_FUNNEL} SELECT id, type, CASE WHEN row_number() OVER (PARTITION BY type ORDER BY md5('11:' || id), id) <= 40 THEN 'eval' ELSE 'train' END AS split FROM fun WHERE fate = 'kept'")
def eval_split_by_type(spark: SparkSession, d: str) -> DataFrame:
    """40 of each type are held out."""
    order = Window.partitionBy("type").orderBy(curate.shuffled("11", F.col("id")), "id")
    return _funnel(spark, d).where("fate = 'kept'").select("id", "type", F.when(F.row_number().over(order) <= 40, "eval").otherwise("train").alias("split"))


_GRAM13 = f"(SELECT id, split, CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM (SELECT id, split, list_filter(string_split({_form('question')}, ' '), lambda x: x <> '') AS w FROM sp))"


@query(f"WITH {_FUNNEL}, sp AS (SELECT id, question, CASE WHEN row_number() OVER (ORDER BY md5('11:' || id), id) <= 200 THEN 'eval' ELSE 'train' END AS split FROM fun WHERE fate = 'kept'), g AS (SELECT id, split, unnest(g) AS g FROM {_GRAM13}) SELECT DISTINCT id FROM g WHERE split = 'train' AND g IN (SELECT g FROM g WHERE split = 'eval')")
def train_decontam(spark: SparkSession, d: str) -> DataFrame:
    """Training questions that share eight words with a held-out one (13 would match none here); short questions count whole."""
    kept = _funnel(spark, d).where("fate = 'kept'").select("id", "question")
    held = kept.orderBy(curate.shuffled("11", F.col("id")), "id").limit(200)
    w = F.filter(F.split(T.question_form(T.text_of(F.col("question"))), " "), lambda x: x != "")
    grams = lambda x: x.select("id", F.explode(F.array_distinct(T.grams(w, 8, "whole"))).alias("g"))
    return grams(kept.join(held.select("id"), "id", "left_anti")).join(grams(held).select("g").distinct(), "g", "left_semi").select("id").distinct()


_IDS = "list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: length(w)::INT)"


@query(f"WITH {_ONCE}, i AS (SELECT id, {_IDS.format('question')} AS p, {_IDS.format('answer')} AS c FROM once) SELECT id, p || c || list_transform(range(0, 48 - len(p) - len(c)), lambda i: 0::INT) AS tokens, list_transform(range(0, 48), lambda i: CASE WHEN i >= len(p) AND i < len(p) + len(c) THEN 1 ELSE 0 END) AS loss_mask, list_transform(range(0, 48), lambda i: CASE WHEN i < len(p) + len(c) THEN 1 ELSE 0 END) AS attn_mask, list_transform(range(1, 49), lambda i: CASE WHEN i > len(p) AND i <= len(p) + len(c) THEN (p || c)[i] ELSE -100 END) AS labels FROM i WHERE len(p) + len(c) <= 48")
def pad_and_mask(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and answer in rows of 48 with their masks and labels; here a word's id is its length."""
    ids = lambda c: F.transform(T.words(T.text_of(F.col(c))), F.length)
    r = _once(spark, d).select("id", curate.padded(ids("question"), ids("answer"), 48).alias("r")).where("r IS NOT NULL").select("id", "r.*")
    return r.withColumn("labels", curate.labels(F.col("tokens"), F.col("loss_mask")))


@query(f"WITH {_ONCE}, i AS (SELECT len({_IDS.format('question')}) AS p, len({_IDS.format('answer')}) AS c FROM once) SELECT count(*) AS examples, count(*) FILTER (p + c > 24) AS dropped, max(p + c)::BIGINT AS longest, count(*) FILTER (p + c <= 24) AS packed, sum(p + c) FILTER (p + c <= 24)::BIGINT AS real, sum(c) FILTER (p + c <= 24)::BIGINT AS supervised FROM i")
def packing_stats(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(T.words(T.text_of(F.col(c))))
    i = _once(spark, d).select(n("question").alias("p"), n("answer").alias("c")).withColumn("n", F.col("p") + F.col("c"))
    fits = F.col("n") <= 24
    return i.agg(F.count("*").alias("examples"), F.count_if(~fits).alias("dropped"), F.max("n").cast("bigint").alias("longest"), F.count_if(fits).alias("packed"), F.sum(F.when(fits, F.col("n"))).alias("real"), F.sum(F.when(fits, F.col("c"))).alias("supervised"))


@query(f"""WITH {_FUNNEL}, pool AS (SELECT * FROM fun WHERE fate = 'kept' AND type IS NOT NULL), k AS (SELECT type, count(*) AS n, CASE type WHEN 'lookup' THEN 0.5 WHEN 'reasoning' THEN 0.3 ELSE 0.2 END::DOUBLE AS share FROM pool GROUP BY type), t AS (SELECT min(floor(n / share)) AS total FROM k),
quota AS (SELECT type, floor(share * total)::BIGINT + CASE WHEN row_number() OVER (ORDER BY share * total - floor(share * total) DESC, type) <= total - sum(floor(share * total)) OVER () THEN 1 ELSE 0 END AS q FROM k, t),
r AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY s DESC, md5('5:' || id), id) AS n FROM pool) SELECT id, type FROM r JOIN quota USING (type) WHERE n <= q""")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    """As many pairs as the scarcest type allows at the shares of the mix, the best of each type."""
    pool = _funnel(spark, d).where("fate = 'kept' AND type IS NOT NULL")
    share = F.when(F.col("type") == "lookup", 0.5).when(F.col("type") == "reasoning", 0.3).otherwise(0.2)
    k = pool.groupBy("type").agg(F.count("*").alias("n")).withColumn("share", share)
    total = int(k.agg(F.min(F.floor(F.col("n") / F.col("share")))).first()[0] or 0)
    quota = curate.allocate(k, "share", "type", total).select("type", "quota")
    r = pool.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("s"), curate.shuffled("5", F.col("id")), "id")))
    return r.join(F.broadcast(quota), "type").where("n <= quota").select("id", "type")


@query("WITH s AS (SELECT * FROM (VALUES ('a', 0.4, 0), ('b', 0.4, 1), ('c', 0.2, 2), ('d', 0.0, 3)) v(part, share, pos)), e AS (SELECT part, pos, share::DOUBLE * 1003 AS x FROM s) SELECT part, (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, pos) <= 1003 - sum(floor(x)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM e")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.createDataFrame([("a", 0.4, 0), ("b", 0.4, 1), ("c", 0.2, 2), ("d", 0.0, 3)], "part string, share double, pos int")
    return curate.allocate(parts, "share", "pos", 1003).select("part", "quota")


_GENERATED = f"""{_ONCE}, gen AS (SELECT id, type, coalesce(question, '') AS question, 'base' AS model, coalesce(context, '') AS generated FROM once UNION ALL SELECT id, type, coalesce(question, ''), 'tuned', coalesce(answer, '') FROM once)"""


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """Contexts stand for what the base model says, answers for what the tuned one does."""
    c = _once(spark, d)
    pair = lambda m, x: F.struct(F.lit(m).alias("model"), T.text_of(F.col(x)).alias("generated"))
    return c.select("id", "type", T.text_of(F.col("question")).alias("question"), F.inline(F.array(pair("base", "context"), pair("tuned", "answer"))))


@query(f"WITH {_GENERATED} SELECT question, md5(arg_min(generated, id) FILTER (model = 'base')) AS base, md5(arg_min(generated, id) FILTER (model = 'tuned')) AS tuned FROM gen GROUP BY question")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Generations pivoted by model, one row for each question, of the smallest id; the pivot's values are given, so no job looks for them."""
    return _generated(spark, d).groupBy("question").pivot("model", ["base", "tuned"]).agg(F.md5(F.min_by("generated", "id")))


_REFUSED_G = _REFUSED.replace("answer", "generated")


@query(rf"""WITH {_GENERATED}, x AS (SELECT *, {_REFUSED_G} AS refused, regexp_matches(generated, '[.!?]{_WS}*$') AS eos, len(regexp_extract_all(lower(generated), '[a-z0-9]+')) AS n FROM gen)
SELECT model, count(*) AS n, count(*) FILTER (type = 'unanswerable') AS unanswerable, round(count(*) FILTER (type = 'unanswerable' AND refused) / greatest(count(*) FILTER (type = 'unanswerable'), 1)::DOUBLE, 3) AS refusal_rate,
 round(count(*) FILTER (coalesce(type, '') <> 'unanswerable' AND refused) / greatest(count(*) FILTER (coalesce(type, '') <> 'unanswerable'), 1)::DOUBLE, 3) AS false_refusal_rate, round(count(*) FILTER (eos) / count(*)::DOUBLE, 3) AS eos_rate, round(avg(n), 1) AS mean_new_tokens FROM x GROUP BY model""")
def model_behaviour(spark: SparkSession, d: str) -> DataFrame:
    """Each model's refusals, false refusals, share of texts that come to an end, and mean length in words."""
    r, u = curate.is_refusal(F.col("generated")), F.coalesce("type", F.lit("")) == "unanswerable"
    rate = lambda on, hit: F.round(F.count_if(on & hit) / F.greatest(F.count_if(on), F.lit(1)), 3)
    eos = F.col("generated").rlike(rf"[.!?]{T.SPACE}*$")
    return _generated(spark, d).groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(u).alias("unanswerable"), rate(u, r).alias("refusal_rate"), rate(~u, r).alias("false_refusal_rate"),
        F.round(F.count_if(eos) / F.count("*"), 3).alias("eos_rate"), F.round(F.avg(F.size(T.words(F.col("generated")))), 1).alias("mean_new_tokens"),
    )


@query(f"""WITH {_ONCE}, i AS (SELECT id, type, verdict, score, row_number() OVER (ORDER BY id) - 1 AS n FROM once), v AS (SELECT n, score FROM i WHERE score IS NOT NULL AND (n // 8) % 7 <> 3)
SELECT i.id, i.n // 8 AS batch, i.n % 8 AS idx, CASE WHEN v.score >= 4 THEN 'correct' ELSE 'wrong' END AS verdict, coalesce(v.score >= 3, false) AS grounded, CASE WHEN v.score IS NULL THEN 'judge_failed' END AS reason FROM i LEFT JOIN v USING (n)""")
def verdict_zip(spark: SparkSession, d: str) -> DataFrame:
    """Answers joined with an accuracy judge's verdicts by batch and index; a missing verdict, or a batch whose call failed (here every seventh), counts as wrong."""
    i = ranked(_once(spark, d).select("id", "score"), [], ["id"], "n").withColumns({"batch": F.floor(F.col("n") / 8), "idx": F.col("n") % 8})
    v = i.where(F.col("score").isNotNull() & (F.col("batch") % 7 != 3)).select("batch", "idx", F.col("score").alias("mark"))
    verdict = F.when(F.col("mark") >= 4, "correct").otherwise("wrong")
    return i.join(v, ["batch", "idx"], "left").select("id", "batch", "idx", verdict.alias("verdict"), F.coalesce(F.col("mark") >= 3, F.lit(False)).alias("grounded"), F.when(F.col("mark").isNull(), "judge_failed").alias("reason"))


#: Of the selection's parameters, those that these tables need to be other than the original's: no answer is longer than 120 characters, and no two of these vectors are as like as 0.88.
LONG, HELD = 80, 0.35
_FAMILY = "regexp_extract(source, '^(case-law|sec|fineweb-edu)')"
_SELECT = f"""{_ONCE}, vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS v FROM embeddings),
c AS (SELECT o.id, {_FAMILY} AS source, type, question, answer, verdict, coalesce(score, 0) AS score, v.v, md5('11:' || o.id) AS o, md5('11:eval:' || o.id) AS e FROM once o LEFT JOIN vec v ON v.vec_id = ('0x' || substring(md5(o.id), 1, 7))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings)),
good AS (SELECT *, row_number() OVER (PARTITION BY {_form('question')} ORDER BY id) AS qn FROM c WHERE verdict = 'keep'),
uniq AS (SELECT *, CASE WHEN length(answer) > {LONG} THEN row_number() OVER (PARTITION BY {_form('answer')}, coalesce(length(answer) > {LONG}, false) ORDER BY id) ELSE 1 END AS an FROM good WHERE qn = 1),
fresh AS (SELECT *, row_number() OVER (ORDER BY score DESC, o, id) AS i FROM uniq WHERE an = 1),
alike AS (SELECT a.i AS a, b.i AS b FROM fresh a JOIN fresh b ON a.i < b.i AND round(list_dot_product(a.v, b.v), 6) >= {curate.NEAR_COSINE}),
turn AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT a AS v FROM alike UNION SELECT b FROM alike)),
pass AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT t.i, CASE WHEN EXISTS (SELECT 1 FROM alike x WHERE x.b = t.v AND list_contains(p.kept, x.a)) THEN p.kept ELSE list_append(p.kept, t.v) END FROM pass p JOIN turn t ON t.i = p.i + 1),
near AS (SELECT f.id FROM fresh f JOIN turn ON f.i = turn.v WHERE NOT list_contains((SELECT kept FROM pass ORDER BY i DESC LIMIT 1), f.i)),
pool AS (SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM near)),
smix AS (SELECT * FROM (VALUES ('case-law', 0.4::DOUBLE, 0), ('sec', 0.4::DOUBLE, 1), ('fineweb-edu', 0.2::DOUBLE, 2)) v(source, share, pos)), tmix AS (SELECT * FROM (VALUES ('lookup', 0.5::DOUBLE, 0), ('reasoning', 0.3::DOUBLE, 1), ('unanswerable', 0.2::DOUBLE, 2)) v(type, share, pos)),
total AS (SELECT least(min(floor(n / share)), 3200)::BIGINT AS total FROM (SELECT source, count(*) AS n FROM pool GROUP BY source) JOIN smix USING (source)),
sx AS (SELECT source, pos, total, share * total AS x FROM smix, total), sq AS (SELECT source, (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, pos) <= total - sum(floor(x)) OVER () THEN 1 ELSE 0 END)::BIGINT AS want FROM sx),
tx AS (SELECT source, want, type, pos, share * want AS x FROM sq, tmix), tq AS (SELECT source, type, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY x - floor(x) DESC, pos) <= want - sum(floor(x)) OVER (PARTITION BY source) THEN 1 ELSE 0 END)::BIGINT AS q FROM tx),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY o, id) AS tr FROM pool), firsts AS (SELECT r.*, r.tr <= coalesce(q, 0) AS f FROM ranks r LEFT JOIN tq USING (source, type)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, o, id) AS n FROM firsts) JOIN sq USING (source) WHERE n <= want),
split AS (SELECT *, row_number() OVER (ORDER BY e, id) <= 200 AS is_eval FROM chosen),
qw AS (SELECT id, is_eval, list_filter(string_split({_form('question')}, ' '), lambda x: x <> '') AS w FROM split),
qg AS (SELECT id, is_eval, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM qw),
bad AS (SELECT id FROM qg WHERE NOT is_eval AND g IN (SELECT g FROM qg WHERE is_eval) UNION SELECT t.id FROM split t JOIN split h ON NOT t.is_eval AND h.is_eval AND round(list_dot_product(t.v, h.v), 6) >= {HELD}),
fates AS (SELECT c.id, CASE WHEN coalesce(c.verdict, '') <> 'keep' THEN 'judge_fail' WHEN g.qn > 1 THEN 'exact_dup' WHEN u.an > 1 THEN 'boilerplate_answer' WHEN c.id IN (SELECT id FROM near) THEN 'near_dup' WHEN s.id IS NULL THEN 'stratify_drop' WHEN s.is_eval THEN 'eval' WHEN c.id IN (SELECT id FROM bad) THEN 'eval_contaminated' ELSE 'kept' END AS fate
  FROM c LEFT JOIN good g USING (id) LEFT JOIN uniq u USING (id) LEFT JOIN split s USING (id))"""


def _selected(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = (v.agg(F.max("v")).first()[0] or 0) + 1
    c = _once(spark, d).withColumn("v", F.conv(F.substring(F.md5("id"), 1, 7), 16, 10).cast("bigint") % n).withColumn("source", F.regexp_extract("source", "^(case-law|sec|fineweb-edu)", 1))
    return curate.select_pairs(c.join(v, "v", "left"), long=LONG, held=HELD)


@query(f"WITH RECURSIVE {_SELECT} SELECT id, fate FROM fates")
def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The whole selection of instruction pairs: each pair's fate, the final training and held-out sets among them."""
    return _selected(spark, d)


_STAGES = ("judge_fail", "exact_dup", "boilerplate_answer", "near_dup", "stratify_drop", "eval_contaminated", "kept", "eval")


@query(f"WITH RECURSIVE {_SELECT} SELECT count(*) AS candidates, " + ", ".join(f"count(*) FILTER (fate = '{x}') AS {x}" for x in _STAGES) + " FROM fates")
def selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each stage drops and what is left."""
    return _selected(spark, d).agg(F.count("*").alias("candidates"), *[F.count_if(F.col("fate") == x).alias(x) for x in _STAGES])
