"""Shuffles, splits, prefixes and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.text import tokens
from promptloom.operators import batches, frames, order
from promptloom.plans.corpus import split_sql
from promptloom.plans.registry import query, table

TOKENS_SQL = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda t: t <> '')"


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(column)


def rank_sql(seed: int, table_name: str = "documents", key: str = "doc_id") -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS rank
        FROM {table_name}"""


@query("shuffle_rank", f"SELECT doc_id, rank FROM ({rank_sql(42)})")
def shuffle_rank(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return order.shuffle_rank(docs, "doc_id", 42)


@query("split_floor", split_sql("documents", "doc_id"))
def split_floor(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return order.split_exact(docs, "doc_id", 0.2, 42)


@query("split_ceil", split_sql("documents", "doc_id", fraction=0.05, rounding="ceil"))
def split_ceil(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return order.split_exact(docs, "doc_id", 0.05, 42, "ceil")


@query("split_grouped", f"""
    WITH keys AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id, turn, split FROM conversations JOIN ({split_sql('keys', 'conv_id')})
        USING (conv_id)""")
def split_grouped(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return order.split_grouped(turns, "conv_id", 0.2, 42)


@query("prefix_fraction", """
    SELECT doc_id, lang FROM documents
    ORDER BY doc_id LIMIT (SELECT count(*) // 6 FROM documents)""")
def prefix_fraction(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return order.prefix_share(docs, 6, "doc_id")


@query("cap_samples", "SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 100")
def cap_samples(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return order.head(turns, 100, [F.asc("conv_id"), F.asc("turn")])


def groups_sql(length: str, batch: int, seed: int) -> str:
    return f"""
    WITH sized AS (SELECT *, greatest(least((SELECT count(*) FROM documents) // ({4 * batch}), 50), 1)
            * {batch} AS size FROM ({rank_sql(seed)})),
    megas AS (SELECT *, (rank - 1) // size AS megabatch, {length} AS len FROM sized)
    SELECT doc_id, megabatch, len,
        row_number() OVER (PARTITION BY megabatch ORDER BY len DESC, rank) AS pos FROM megas"""


@query("length_groups", f"SELECT doc_id, megabatch, pos FROM ({groups_sql('n_chars', 2, 7)})")
def length_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return batches.length_groups(docs, "doc_id", "n_chars", 2, 7).drop("n_chars")


@query("assign_batches", f"""
    SELECT doc_id, (rank - 1) // 2 AS micro, (rank - 1) // 2 // 4 AS step FROM ({rank_sql(42)})""")
def assign_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    ranked = order.shuffle_rank(docs, "doc_id", 42)
    return ranked.withColumns(batches.assign_batches("rank", 2, 4)).drop("rank")


@query("padding_waste", f"""
    WITH grouped AS ({groups_sql('len(' + tokens_sql('text') + ')', 8, 7)}),
    shuffled AS (SELECT (rank - 1) // 8 AS batch, len({tokens_sql('text')}) AS len
        FROM ({rank_sql(7)})),
    batches AS (
        SELECT 'shuffle' AS batching, max(len) AS longest, count(*) AS n, sum(len) AS total
        FROM shuffled GROUP BY batch
        UNION ALL
        SELECT 'length_groups', max(len), count(*), sum(len)
        FROM grouped GROUP BY megabatch, (pos - 1) // 8)
    SELECT batching, count(*) AS batches, CAST(sum(total) AS BIGINT) AS real_tokens,
        CAST(sum(longest * n - total) AS BIGINT) AS pad_tokens FROM batches GROUP BY batching""")
def padding_waste(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", F.size(tokens("text")).cast("bigint").alias("len")
    )
    shuffled = order.shuffle_rank(docs, "doc_id", 7).withColumns(batches.assign_batches("rank", 8, 1))
    grouped = batches.length_groups(docs, "doc_id", "len", 8, 7).withColumn(
        "micro", batches.grouped_batch(8)
    )
    return batches.padding_waste(shuffled, ["micro"], "len").select(
        F.lit("shuffle").alias("batching"), "*"
    ).unionByName(
        batches.padding_waste(grouped, ["megabatch", "micro"], "len").select(
            F.lit("length_groups").alias("batching"), "*"
        )
    )


@query("log_every", "SELECT event_id, user_id, value FROM events WHERE event_id % 25 = 0")
def log_every(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return frames.log_every(events, "event_id", 25)
