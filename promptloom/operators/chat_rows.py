"""Conversations to fitted token rows with the supervised tokens marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import tokens
from promptloom.operators.vocabulary import encode


def chat_token_counts(pieces: DataFrame, key: str, limit: int) -> DataFrame:
    """``key, n_tokens, n_supervised, truncated`` for rows cut to ``limit`` tokens.

    Works on the pieces' positions alone: no conversation is put together.
    """
    learnt_from = F.col("start") + F.col("lead")
    learnt_to = F.least(F.col("start") + F.col("n_tokens"), F.lit(limit))
    learnt = F.when(
        F.col("role") == "assistant", F.greatest(learnt_to - learnt_from, F.lit(0))
    ).otherwise(F.lit(0))
    return pieces.groupBy(key).agg(
        F.max("total").alias("_total"), F.sum(learnt).alias("n_supervised")
    ).select(
        key, F.least("_total", F.lit(limit)).alias("n_tokens"), "n_supervised",
        (F.col("_total") > limit).alias("truncated"),
    )


def chat_rows(pieces: DataFrame, key: str, order: str, vocab: DataFrame, limit: int) -> DataFrame:
    """``key, ids, tags``: the first ``limit`` token ids of each conversation, tag 1 where an
    assistant speaks.

    Only pieces that start before the limit are gathered.  Each has at least two tokens, so a row
    gathers at most half of ``limit`` pieces, whatever the conversation holds.
    """
    toks = F.slice(
        tokens("piece"), F.lit(1), (F.lit(limit) - F.col("start")).cast("int")
    )
    kept = pieces.filter(F.col("start") < limit).select(
        key, F.col(order).alias("_at"), toks.alias("_toks"),
        F.when(F.col("role") == "assistant", F.col("lead")).alias("_from"),
    )
    tags = F.transform(
        "_toks",
        lambda t, i: F.when(F.coalesce(i >= F.col("_from"), F.lit(False)), 1).otherwise(0),
    )
    entry = F.struct("_at", "_toks", tags.alias("_tags"))
    rows = kept.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_pieces"))
    rows = rows.select(
        key,
        F.flatten(F.transform("_pieces", lambda p: p.getField("_toks"))).alias("_toks"),
        F.flatten(F.transform("_pieces", lambda p: p.getField("_tags"))).alias("_tags"),
    )
    return encode(rows, key, F.col("_toks"), vocab, tags=F.col("_tags"))
