"""Queries of evaluation figures. The tables hold no model's output, so other columns stand for predictions, losses and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import curate, evalstats
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table

_P = "pr AS (SELECT event_id, event_type, value, user_id % 40 AS t, (user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 40 AS p FROM events)"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "value", (F.col("user_id") % 40).alias("t"), ((F.col("user_id") + (F.col("event_id") % 3 == 0).cast("int")) % 40).alias("p"))


@query("SELECT event_type, round(sum(value * (event_id % 9 + 1)) / sum(event_id % 9 + 1), 6) AS loss, sum(event_id % 9 + 1)::BIGINT AS n, round(exp(least(sum(value * (event_id % 9 + 1)) / sum(event_id % 9 + 1), 20)), 2) AS perplexity FROM events GROUP BY ROLLUP (event_type)")
def perplexity_by_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.col("event_id") % 9 + 1)
    return evalstats.perplexity(e, "event_type", "value", "n").select("event_type", F.round("loss", 6).alias("loss"), "n", F.round("perplexity", 2).alias("perplexity"))


@query(f"WITH {_P} SELECT event_type, round(avg((t = p)::INT), 6) AS top1, round(avg((t IN (p, p + 1, p + 2, p - 1, p - 2))::INT), 6) AS top5 FROM pr GROUP BY ROLLUP (event_type)")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    five = F.array(*[F.col("p") + k for k in (0, 1, 2, -1, -2)])
    return _pred(spark, d).rollup("event_type").agg(F.round(F.avg((F.col("t") == F.col("p")).cast("int")), 6).alias("top1"), F.round(F.avg(F.array_contains(five, F.col("t")).cast("int")), 6).alias("top5"))


_CLASSES = f"{_P}, c AS (SELECT c, sum(h)::BIGINT AS hits, sum(pp)::BIGINT AS predicted, sum(tt)::BIGINT AS support FROM (SELECT t AS c, (t = p)::INT AS h, 1 AS tt, 0 AS pp FROM pr UNION ALL SELECT p, 0, 0, 1 FROM pr) GROUP BY c), m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, row_number() OVER (ORDER BY support DESC, c) AS r FROM m)"


@query(f"WITH {_CLASSES} SELECT c, hits, predicted, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    x = evalstats.per_class(_pred(spark, d), "t", "p")
    return x.select("c", "hits", "predicted", "support", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


@query(f"WITH {_CLASSES} SELECT count(*) FILTER (support > 0) AS present, count(*) FILTER (support > 0 AND predicted = 0) AS never_predicted, round(sum(hits) / sum(support)::DOUBLE, 6) AS micro, round(avg(precision) FILTER (support > 0), 6) AS macro_precision, round(avg(recall) FILTER (support > 0), 6) AS macro_recall, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(avg(precision) FILTER (r <= 20), 6) AS top_precision, round(avg(recall) FILTER (r <= 20), 6) AS top_recall, count(*) FILTER (support > 0 AND support < 250) AS rare, round(avg(recall) FILTER (support > 0 AND support < 250), 6) AS rare_recall, round(sum(support) FILTER (r <= 20) / sum(support)::DOUBLE, 6) AS top_share FROM f")
def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    return evalstats.macro(evalstats.per_class(_pred(spark, d), "t", "p"), 20, 250)


@query("WITH e AS (SELECT user_id, event_id, value, exp(value - max(value) OVER (PARTITION BY user_id)) AS e FROM events), p AS (SELECT user_id, event_id, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e) SELECT user_id, event_id, round(p, 6) AS p FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) <= 10")
def topk_next(spark: SparkSession, d: str) -> DataFrame:
    """The ten most probable events of each user, as next tokens of a prompt."""
    return evalstats.top_tokens(table(spark, d, "events"), "user_id", "event_id", "value", 10).select("user_id", "event_id", F.round("p", 6).alias("p"))


_REFUSED = "(" + " OR ".join(f"contains(lower(coalesce(answer, '')), '{m}')" for m in curate.REFUSAL_MARKS) + ")"
_ONCE = "once AS (SELECT DISTINCT id, source, type, answer, llm_judge_score AS score, llm_judge_reason AS why FROM candidate)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").select("id", "source", "type", "answer", F.col("llm_judge_score").alias("score"), F.col("llm_judge_reason").alias("why")).distinct()


@query(f"WITH {_ONCE} SELECT source, count(*) AS pairs, count(*) FILTER (type = 'unanswerable') AS unanswerable, round(count(*) FILTER (type = 'unanswerable' AND {_REFUSED}) / greatest(count(*) FILTER (type = 'unanswerable'), 1)::DOUBLE, 3) AS refusal_rate, round(count(*) FILTER (type <> 'unanswerable' AND {_REFUSED}) / greatest(count(*) FILTER (type <> 'unanswerable'), 1)::DOUBLE, 3) AS false_refusal_rate, round(avg(len(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+'))), 1) AS mean_words FROM once GROUP BY source")
def behaviour_rates(spark: SparkSession, d: str) -> DataFrame:
    """Refusals where there is no answer, and where there is one."""
    r, u = curate.is_refusal(F.col("answer")), F.col("type") == "unanswerable"
    rate = lambda on: F.round(F.count_if(on & r) / F.greatest(F.count_if(on), F.lit(1)), 3)
    return _once(spark, d).groupBy("source").agg(F.count("*").alias("pairs"), F.count_if(u).alias("unanswerable"), rate(u).alias("refusal_rate"), rate(F.col("type") != "unanswerable").alias("false_refusal_rate"), F.round(F.avg(F.size(T.words(T.text_of(F.col("answer"))))), 1).alias("mean_words"))


@query(f"WITH {_ONCE} SELECT type, round(avg((coalesce(score, 0) >= 4)::INT), 4) AS accuracy, round(avg(coalesce((why <> 'adds a claim')::INT, 0)), 4) AS grounded, round(avg({_REFUSED}::INT), 4) AS refused, round(avg((NOT coalesce(why <> 'adds a claim', false) AND NOT {_REFUSED})::INT), 4) AS hallucinated, count(*) AS pairs FROM once GROUP BY GROUPING SETS ((), (type))")
def judged_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by type and over all; hallucinated is neither grounded nor a refusal."""
    g, r = F.coalesce(F.col("why") != "adds a claim", F.lit(False)), curate.is_refusal(F.col("answer"))
    mean = lambda c: F.round(F.avg(c.cast("int")), 4)
    return _once(spark, d).rollup("type").agg(mean(F.coalesce("score", F.lit(0)) >= 4).alias("accuracy"), mean(g).alias("grounded"), mean(r).alias("refused"), mean(~g & ~r).alias("hallucinated"), F.count("*").alias("pairs")).select("type", "accuracy", "grounded", "refused", "hallucinated", "pairs")


@query("WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE * 10 AS step, value FROM events), n AS (SELECT user_id, step, value, lead(step) OVER w AS s2, lead(value) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY step)) SELECT user_id, q.at::DOUBLE AS at, round(value + (v2 - value) * (q.at - step) / (s2 - step), 6) AS value FROM n JOIN (SELECT unnest([15, 42, 57, 110]) AS at) q ON q.at >= step AND q.at < s2")
def curve_at(spark: SparkSession, d: str) -> DataFrame:
    """A metric's value between its steps, by the bracket of the next row; the steps asked for are exploded inside it, not joined."""
    of = Window.partitionBy("user_id")
    c = table(spark, d, "events").select("user_id", (F.row_number().over(of.orderBy("ts", "event_id")) * 10.0).alias("step"), "value")
    n = c.withColumns({"s2": F.lead("step").over(of.orderBy("step")), "v2": F.lead("value").over(of.orderBy("step"))}).where("s2 IS NOT NULL")
    asked = F.filter(F.array(*[F.lit(float(x)) for x in (15, 42, 57, 110)]), lambda x: (x >= F.col("step")) & (x < F.col("s2")))
    return n.withColumn("at", F.explode(asked)).select("user_id", "at", F.round(F.col("value") + (F.col("v2") - F.col("value")) * (F.col("at") - F.col("step")) / (F.col("s2") - F.col("step")), 6).alias("value"))


@query("SELECT name, round(token_budget + token_budget * 15.0 * (1 - exp(-(max_repeats - 1) / 15.0)), 2)::DOUBLE AS effective FROM source_config")
def effective_data(spark: SparkSession, d: str) -> DataFrame:
    """What repeated data are worth."""
    u, r = F.col("token_budget").cast("double"), F.col("max_repeats") - 1
    return table(spark, d, "source_config").select("name", F.round(u + u * 15.0 * (1 - F.exp(-r / F.lit(15.0))), 2).alias("effective"))


@query("SELECT build_id, source, shard, coalesce(train_tokens, train_windows * seq_len)::BIGINT AS train_tokens, train_tokens IS NULL AS filled FROM token_index")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """A derived figure only where it is missing."""
    return table(spark, d, "token_index").select("build_id", "source", "shard", F.coalesce("train_tokens", F.col("train_windows") * F.col("seq_len")).alias("train_tokens"), F.col("train_tokens").isNull().alias("filled"))


@query("SELECT source, arg_min(shard, (train_windows, shard)) AS shard, min(train_windows)::BIGINT AS windows FROM token_index GROUP BY source")
def best_setting(spark: SparkSession, d: str) -> DataFrame:
    """The row of least cost; the first by shard wins ties."""
    return table(spark, d, "token_index").groupBy("source").agg(F.min_by("shard", F.struct("train_windows", "shard")).alias("shard"), F.min("train_windows").alias("windows"))
