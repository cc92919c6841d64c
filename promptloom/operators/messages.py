"""Long message rows to message arrays and token rows.

A conversation may hold any number of turns, so nothing gathers a whole one.  Its rows are cut into
*parts* of ``PART`` order values; what a part must know of its conversation (is it the first, where
is the last query, how many tokens come before) is computed on one narrow row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions import templates as T
from promptloom.functions.text import tokens

PART = 256
# parts of a conversation that are looked at by one task
STRETCH = 256


def part_of(order: str, size: int = PART) -> Column:
    return F.floor(F.col(order) / size)


def gather_messages(
    df: DataFrame, key: str, order: str, role: str = "role", content: str = "text",
    part_size: int = 1,
) -> DataFrame:
    """``key, part, messages, context`` with at most ``part_size`` messages in a row.

    ``order`` is an integer, unique inside a key.  With one message to a row, ``part`` is its place,
    and the renderings of a conversation's rows joined in that order are the whole one's, however
    long it is.
    """
    rows = df.select(
        key, part_of(order, part_size).alias("part"), F.col(order).alias("_at"),
        F.col(role).alias("_role"), F.col(content).alias("_content"),
    )
    query = F.when(T.is_query(F.col("_role"), F.col("_content")), F.col("_at"))
    narrow = rows.groupBy(key, "part").agg(
        F.min_by("_role", "_at").alias("_first"), F.max_by("_role", "_at").alias("_last"),
        F.max(query).alias("_query"), F.max("_at").alias("_end"),
    )
    # two levels, as a conversation may have any number of parts: inside a stretch of them, and from stretch to stretch
    narrow = narrow.withColumn("_stretch", F.floor(F.col("part") / STRETCH))
    stretches = narrow.groupBy(key, "_stretch").agg(
        F.min_by("_first", "part").alias("_head"), F.max_by("_last", "part").alias("_tail"),
        F.max("_query").alias("_query"), F.max("_end").alias("_end"),
    )
    whole, along = Window.partitionBy(key), Window.partitionBy(key).orderBy("_stretch")
    stretches = stretches.select(
        key, "_stretch",
        F.lag("_stretch").over(along).isNull().alias("_foremost"),
        F.lead("_stretch").over(along).isNull().alias("_hindmost"),
        F.coalesce(F.max("_query").over(whole), F.max("_end").over(whole)).alias("_query_at"),
        F.lag("_tail").over(along).alias("_tail_before"),
        F.lead("_head").over(along).alias("_head_behind"),
    )
    ordered = Window.partitionBy(key, "_stretch").orderBy("part")
    foremost, hindmost = F.lag("part").over(ordered).isNull(), F.lead("part").over(ordered).isNull()
    about = narrow.join(stretches, [key, "_stretch"]).select(
        key, "part", "_query_at",
        (foremost & F.col("_foremost")).alias("_opens"),
        (hindmost & F.col("_hindmost")).alias("_closes"),
        F.when(foremost, F.col("_tail_before")).otherwise(F.lag("_last").over(ordered)).alias("_prev"),
        F.when(hindmost, F.col("_head_behind")).otherwise(F.lead("_first").over(ordered)).alias("_next"),
    )
    gathered = rows.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_role", "_content"))).alias("_rows")
    )
    upto_query = F.filter("_rows", lambda m: m.getField("_at") <= F.col("_query_at"))
    return gathered.join(about, [key, "part"]).select(
        key, "part",
        F.transform(
            "_rows",
            lambda m: F.struct(
                m.getField("_role").alias("role"), m.getField("_content").alias("content")
            ),
        ).alias("messages"),
        F.struct(
            F.col("_opens").alias("opens"), F.col("_closes").alias("closes"),
            (F.size(upto_query) - 1).alias("last_query_at"),
            F.col("_prev").alias("prev_role"), F.col("_next").alias("next_role"),
        ).alias("context"),
    )


def with_opening(
    df: DataFrame, rows: DataFrame, key: str, order: str, role: str, content: str,
    out: str = "system", default: str = T.DEFAULT_SYSTEM, part_size: int = PART,
) -> DataFrame:
    """Adds to ``df`` the opening system text of its conversation in ``rows``, or the default.

    The text is carried to every part, so the join has at most ``part_size`` rows per key.  Until
    then only the role of a part's first message and the text of system turns are moved.
    """
    said = F.when(F.col(role) == "system", F.col(content))
    opening = rows.groupBy(key, part_of(order, part_size).alias("_part")).agg(
        F.min_by(F.struct(F.col(role).alias("r"), said.alias("c")), order).alias("_m")
    )
    first = F.first("_m").over(Window.partitionBy(key).orderBy("_part"))
    carried = opening.select(key, "_part", first.alias("_m"))
    return (
        df.withColumn("_part", part_of(order, part_size))
        .join(carried, [key, "_part"])
        .withColumn(
            out,
            F.when(F.col("_m.r") == "system", F.col("_m.c")).otherwise(F.lit(default)),
        )
        .drop("_part", "_m")
    )


def chat_pieces(
    df: DataFrame, key: str, order: str, role: str = "role", content: str = "text",
    part_size: int = PART,
) -> DataFrame:
    """Every message with its ChatML text and where its tokens stand in the conversation.

    Columns ``key, order, role, piece, lead, n_tokens, start, total``: ``lead`` tokens of the piece
    are markup before the content, ``start`` tokens of the conversation come before it, ``total`` is
    the conversation's length.  A default system turn belongs to the first message's piece.
    """
    rows = df.select(
        key, order, F.col(role).alias("role"), part_of(order, part_size).alias("_part"),
        T.chatml_piece(role, content).alias("_piece"),
    ).withColumn("_n", F.size(tokens("_piece")).cast("bigint"))
    default = T.chatml_piece(F.lit("system"), F.lit(T.DEFAULT_SYSTEM))
    default_tokens = F.size(tokens(default)).cast("bigint")

    narrow = rows.groupBy(key, "_part").agg(
        F.sum("_n").alias("_tokens"), F.min(order).alias("_first"),
        F.min_by("role", order).alias("_role"),
    )
    whole, ordered = Window.partitionBy(key), Window.partitionBy(key).orderBy("_part")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    about = (
        narrow.withColumn(
            "_bare", F.lag("_part").over(ordered).isNull() & (F.col("_role") != "system")
        )
        .withColumn("_tokens", F.col("_tokens") + F.when(F.col("_bare"), default_tokens).otherwise(0))
        .select(
            key, "_part", "_bare", "_first",
            F.coalesce(F.sum("_tokens").over(upto), F.lit(0)).alias("_before"),
            F.sum("_tokens").over(whole).alias("total"),
        )
    )
    bare = F.col("_bare") & (F.col(order) == F.col("_first"))
    inside = (
        Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(about, [key, "_part"])
        .withColumns(
            {
                "piece": F.when(bare, F.concat(default, F.col("_piece"))).otherwise(
                    F.col("_piece")
                ),
                "lead": F.when(bare, default_tokens + 1).otherwise(F.lit(1)),
                "n_tokens": F.col("_n") + F.when(bare, default_tokens).otherwise(0),
            }
        )
        .withColumn(
            "start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
        )
        .select(key, order, "role", "piece", "lead", "n_tokens", "start", "total")
    )
