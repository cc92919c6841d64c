"""Joins: by position, by path, by nearest case, and the train/test leakage check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.operators.order import global_rank, skew_join, stamped_order


def zip_by_position(
    a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column], pos: str = "pos"
) -> DataFrame:
    """Row n of ``a`` beside row n of ``b``, up to the shorter one's end."""
    return global_rank(a, order_a, pos).join(global_rank(b, order_b, pos), pos)


def pair_files(prompts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Each prompt with the answer of the same path.  Paths are unique on both sides."""
    return prompts.join(answers, keys)


def unpaired_files(prompts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts without an answer."""
    return prompts.join(answers.select(*keys), keys, "left_anti")


def pair_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation rows as (user turns, assistant turns keyed by the turn they answer)."""
    prompts = df.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    answers = df.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return prompts, answers


def map_lookup(df: DataFrame, keys: list[str], paths: str, files: str) -> DataFrame:
    """One row per listed path with its text, null when the map lacks it.  No shuffle."""
    return df.select(*keys, files, F.explode(paths).alias("path")).select(
        *keys, "path", F.try_element_at(files, F.col("path")).alias("value")
    )


def attach_similar(
    requirements: DataFrame, cases: DataFrame, same: list[str], size: str, key: str,
    case_key: str = "case_id",
) -> DataFrame:
    """The most similar case of each requirement: equal in ``same``, nearest in ``size``.

    Ties go to the smaller case key; a requirement without any case keeps nulls.  Cases are first
    reduced to one per distinct size, and no pair of a requirement with a case that loses is ever
    built.  The sizes are sorted over all tasks, so that a group of any size is spread over several;
    what a task needs of its neighbours is the nearest case beyond its border.
    """
    spots = cases.groupBy(*same, size).agg(F.min(key).alias("_case")).unionByName(
        requirements.select(*same, size).distinct(), allowMissingColumns=True
    )
    spots = spots.groupBy(*same, size).agg(F.max("_case").alias("_case"))
    here = F.when(
        F.col("_case").isNotNull(), F.struct(F.col(size).alias("s"), F.col("_case").alias("c"))
    )
    # a struct, since a null in the metadata is a value like any other here and equals itself
    spots = stamped_order(spots.withColumn("_group", F.struct(*same)), [F.asc(c) for c in [*same, size]])
    rows = (Window.unboundedPreceding, Window.currentRow)
    stretch = Window.partitionBy("_task", "_group")
    below, above = (stretch.orderBy(o).rowsBetween(*rows) for o in (F.asc("_at"), F.desc("_at")))
    near = spots.withColumn("_low", F.last(here, ignorenulls=True).over(below)).withColumn(
        "_high", F.last(here, ignorenulls=True).over(above)
    )
    # one row for each task and group: a group has no more of them than there are tasks
    rims = spots.groupBy("_task", "_group").agg(
        F.max(F.when(here.isNotNull(), F.struct("_at", here.alias("h")))).alias("_last"),
        F.min(F.when(here.isNotNull(), F.struct("_at", here.alias("h")))).alias("_first"),
    )
    beyond = Window.partitionBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    rims = rims.select(
        "_task", "_group",
        F.last("_last.h", ignorenulls=True).over(beyond.orderBy(F.asc("_task"))).alias("_before"),
        F.last("_first.h", ignorenulls=True).over(beyond.orderBy(F.desc("_task"))).alias("_after"),
    )
    near = near.join(rims, ["_task", "_group"]).withColumns(
        {"_low": F.coalesce("_low", "_before"), "_high": F.coalesce("_high", "_after")}
    )

    def candidate(side: str) -> Column:
        return F.when(
            F.col(side).isNotNull(),
            F.struct(
                F.abs(F.col(f"{side}.s") - F.col(size)).alias("gap"),
                F.col(f"{side}.c").alias("case"),
            ),
        )

    best = near.withColumn("_best", F.array_min(F.array(candidate("_low"), candidate("_high"))))
    best = best.filter(F.col("_best").isNotNull()).select(
        *same, size, F.col("_best.case").alias(case_key), F.col("_best.gap").alias("gap")
    )
    return skew_join(requirements, best, same + [size], [key], "left")


def leakage(df: DataFrame, key: str, text: str) -> DataFrame:
    """Test rows whose whole text also stands in a train row.  Needs the ``split`` column.

    Digests are gathered per text first, with the keys of the test rows only where the text is on
    both sides; partial sums take care of a text that many rows share.
    """
    hashed = df.select(key, "split", F.md5(text).alias("text_md5"))
    sides = hashed.groupBy("text_md5").agg(
        F.max(F.col("split") == "train").alias("_train"), F.max(F.col("split") == "test").alias("_test")
    )
    both = sides.filter(F.col("_train") & F.col("_test")).select("text_md5")
    tested = hashed.filter(F.col("split") == "test").select(key, "text_md5")
    return tested.join(both, "text_md5", "left_semi").select("text_md5", key)
