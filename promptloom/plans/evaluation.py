"""Scores, run comparisons and the step log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import text as X
from promptloom.functions.masks import IGNORE
from promptloom.functions.templates import chatml, generation_messages
from promptloom.operators import metrics, order, scoring
from promptloom.plans.corpus import PAIRS_SQL, labelled, paired
from promptloom.plans.ordering import tokens_sql
from promptloom.plans.prompts import CHAT_SQL, chat_corpus
from promptloom.plans.registry import query, table
from promptloom.session import scratch_path
from promptloom.streaming import steplog

_SCORED_SQL = """
    SELECT lang, coalesce(quality, -100) AS label, CAST(n_chars > 1000 AS INTEGER) AS pred,
        (n_chars % 64) / 16 AS loss
    FROM documents LEFT JOIN labels USING (doc_id)"""
_COUNTS_SQL = """CAST(sum(CASE WHEN label <> -100 AND pred = label THEN 1 ELSE 0 END) AS BIGINT)
        AS correct, CAST(sum(CASE WHEN label <> -100 THEN 1 ELSE 0 END) AS BIGINT) AS valid,
    round(sum(CASE WHEN label <> -100 AND pred = label THEN 1 ELSE 0 END)
        / nullif(sum(CASE WHEN label <> -100 THEN 1 ELSE 0 END), 0), 6) AS accuracy,
    round(sum(loss), 6) AS loss_sum, count(loss) AS steps, round(sum(loss) / count(loss), 6) AS mean_loss"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label, ignored where there is none, a prediction and a loss by length.

    The loss is a sixteenth of a whole number, so that its sum is the same in any order.
    """
    return labelled(spark, folder).select(
        "lang", F.coalesce("quality", F.lit(IGNORE)).alias("label"),
        (F.col("n_chars") > 1000).cast("int").alias("pred"), (F.col("n_chars") % 64 / 16).alias("loss"),
    )


@query("masked_accuracy", f"SELECT lang, {_COUNTS_SQL} FROM ({_SCORED_SQL}) GROUP BY lang")
def masked_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.masked_accuracy(scored(spark, folder), "pred", "label", ["lang"], loss="loss")


@query("eval_summary", f"""
    SELECT lang, {_COUNTS_SQL} FROM ({_SCORED_SQL}) GROUP BY lang
    UNION ALL SELECT 'total', {_COUNTS_SQL} FROM ({_SCORED_SQL})""")
def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.eval_summary(scored(spark, folder), "pred", "label", "lang", loss="loss")


@query("reduce_ranks", """
    WITH log AS (SELECT event_id // 100 AS step, value AS loss,
        CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS correct,
        CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS valid FROM events)
    SELECT step, count(*) AS n, round(sum(loss) / count(*), 6) AS loss,
        CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(valid) AS BIGINT) AS valid,
        round(sum(correct) / nullif(sum(valid), 0), 6) AS accuracy FROM log GROUP BY step""")
def reduce_ranks(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 100).alias("step"), F.col("value").alias("loss"),
        F.when(kind.isin("click", "purchase"), 1).otherwise(0).alias("correct"),
        F.when(kind != "error", 1).otherwise(0).alias("valid"),
    )
    return metrics.reduce_ranks(log, "step", "loss", "correct", "valid")


@query("tokens_per_second", f"""
    SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN len({tokens_sql('text')}) ELSE 0 END)
            AS BIGINT) AS valid, 1 + max(turn) AS elapsed,
        round(sum(CASE WHEN role = 'assistant' THEN len({tokens_sql('text')}) ELSE 0 END)
            / (1 + max(turn)), 6) AS tokens_per_second
    FROM conversations GROUP BY conv_id""")
def tokens_per_second(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.when(F.col("role") == "assistant", F.size(X.tokens("text"))).otherwise(0)
    return metrics.tokens_per_second(
        table(spark, folder, "conversations"), ["conv_id"], F.sum(answer), F.max("turn") + 1
    )


@query("leaderboard", """
    WITH runs AS (SELECT user_id, event_type, arg_min(value, event_id) AS first_loss,
            arg_max(value, event_id) AS last_loss FROM events GROUP BY user_id, event_type),
    drops AS (SELECT *, round(first_loss - last_loss, 6) AS loss_drop FROM runs)
    SELECT *, rank() OVER (PARTITION BY event_type ORDER BY loss_drop DESC) AS place FROM drops""")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return metrics.leaderboard(log, "user_id", "event_type", "event_id", "value")


@query("running_loss", """
    SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS mean_loss FROM events""")
def running_loss(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("event_id", "user_id", "value")
    moved = order.moving_average(log, "user_id", "event_id", "value", 25)
    return moved.select("event_id", "user_id", F.round("moving", 6).alias("mean_loss"))


@query("compare_runs", """
    SELECT user_id, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b,
        round(b.mean - a.mean, 6) AS delta, round(b.mean / nullif(a.mean, 0), 6) AS ratio
    FROM (SELECT user_id, avg(value) AS mean FROM events WHERE event_type = 'click'
        GROUP BY user_id) a
    FULL OUTER JOIN (SELECT user_id, avg(value) AS mean FROM events WHERE event_type <> 'click'
        GROUP BY user_id) b USING (user_id)""")
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select("user_id", "event_type", "value")
    a = log.filter(F.col("event_type") == "click")
    b = log.filter(F.col("event_type") != "click")
    return metrics.compare_runs(a, b, "user_id", "value")


_ANSWERED_SQL = f"""
    SELECT conv_id, turn, '<think>' || chr(10) || string_split(prompt, chr(10))[1] || chr(10)
            || '</think>' AS thinking,
        trim(array_to_string(list_reverse(string_split(prompt, chr(10))), chr(10)), chr(10))
            AS content
    FROM ({PAIRS_SQL})"""


@query("score_stub", _ANSWERED_SQL)
def score_stub(spark: SparkSession, folder: str) -> DataFrame:
    prompts = paired(spark, folder).select("conv_id", "turn", "prompt")
    answered = scoring.score(prompts, scoring.echo_model, "prompt", "generated")
    cut = answered.withColumn("_s", X.split_thinking("generated"))
    return cut.select("conv_id", "turn", "_s.thinking", "_s.content")


@query("score_resumed", _ANSWERED_SQL)
def score_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A run over the first turns, then one over all of them that goes on with the log of the first."""
    prompts = paired(spark, folder).select("conv_id", "turn", "prompt")
    log = scratch_path(spark, "generated")
    key = ["conv_id", "turn"]
    scoring.score_resumable(prompts.filter("turn <= 1"), scoring.echo_model, "prompt", "generated", log, key)
    answered = scoring.score_resumable(prompts, scoring.echo_model, "prompt", "generated", log, key)
    cut = answered.withColumn("_s", X.split_thinking("generated"))
    return cut.select("conv_id", "turn", "_s.thinking", "_s.content")


@query("compare_generated", f"""
    WITH lines AS (SELECT turn, prompt, answer, list_distinct(string_split(answer, chr(10))) AS a,
        list_distinct(string_split(prompt, chr(10))) AS b FROM ({PAIRS_SQL}))
    SELECT turn, count(*) AS n,
        CAST(sum(CASE WHEN prompt = answer THEN 1 ELSE 0 END) AS BIGINT) AS exact,
        round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6)
            AS line_overlap,
        round(avg(length(answer) / greatest(length(prompt), 1)), 6) AS length_ratio
    FROM lines GROUP BY turn""")
def compare_generated(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.compare_generated(paired(spark, folder), "answer", "prompt", ["turn"])


_GENERATED_SQL = f"""
    WITH asked AS (SELECT turn, answer, '<|im_start|>system' || chr(10) || system || '<|im_end|>'
            || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
            || '<|im_start|>assistant' || chr(10) AS text FROM ({CHAT_SQL})),
    told AS (SELECT turn, answer, trim(array_to_string(list_reverse(string_split(text, chr(10))),
        chr(10)), chr(10)) AS content FROM asked),
    lines AS (SELECT *, list_distinct(string_split(content, chr(10))) AS a,
        list_distinct(string_split(answer, chr(10))) AS b FROM told)
    SELECT turn, count(*) AS n,
        CAST(sum(CASE WHEN content = answer THEN 1 ELSE 0 END) AS BIGINT) AS exact,
        round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6)
            AS line_overlap,
        round(avg(length(content) / greatest(length(answer), 1)), 6) AS length_ratio
    FROM lines GROUP BY turn"""


@query("generate_and_compare", _GENERATED_SQL)
def generate_and_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts rendered, scored, the thinking cut off, the rest compared with the true answers."""
    corpus = chat_corpus(spark, folder)
    asked = corpus.select(
        "conv_id", "turn", "answer",
        chatml(generation_messages("system", "prompt"), generation_prompt=True).alias("text"),
    )
    told = scoring.score(asked, scoring.echo_model, "text", "generated")
    told = told.withColumn("content", X.split_thinking("generated").content)
    return metrics.compare_generated(told, "content", "answer", ["turn"])


_WINDOWS_SQL = """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
        count(*) AS n, round(sum(value) / count(*), 6) AS mean_value
    FROM events GROUP BY 1, 2"""


@query("step_log_windows", _WINDOWS_SQL)
def step_log_windows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    return steplog.step_log_windows(events, "ts", "event_type", "value")


@query("step_log_stream", _WINDOWS_SQL)
def step_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = steplog.read_log_stream(spark, folder, "events.parquet", schema)
    return steplog.step_log_stream(stream, "ts", "event_type", "value")


@query("step_log_replayed", _WINDOWS_SQL)
def step_log_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The log of a run that broke in the middle and logs its last half hour once more when it goes on."""
    events = table(spark, folder, "events")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    middle = F.timestamp_seconds((F.unix_timestamp(low) + F.unix_timestamp(high)) / 2)
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "windows")
    for arrived in (F.col("ts") < middle, F.col("ts") >= middle - F.expr("INTERVAL 30 MINUTES")):
        events.filter(arrived).write.mode("append").parquet(source)
        stream = steplog.read_log_stream(spark, source, "*.parquet", events.schema)
        windows = steplog.step_log_stream(stream, "ts", "event_type", "value", target=target, step=["event_id"])
    return windows


@query("step_log_late", _WINDOWS_SQL)
def step_log_late(spark: SparkSession, folder: str) -> DataFrame:
    """The log arrives in halves, each picked up by a run that goes on where the last one stopped;
    a third run meets the first hour's rows once more, too late to count."""
    events = table(spark, folder, "events")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    middle = F.timestamp_seconds((F.unix_timestamp(low) + F.unix_timestamp(high)) / 2)
    arrivals = [F.col("ts") < middle, F.col("ts") >= middle, F.col("ts") < low + F.expr("INTERVAL 1 HOUR")]
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "windows")
    for arrived in arrivals:
        events.filter(arrived).write.mode("append").parquet(source)
        stream = steplog.read_log_stream(spark, source, "*.parquet", events.schema)
        windows = steplog.step_log_stream(stream, "ts", "event_type", "value", target=target)
    return windows
