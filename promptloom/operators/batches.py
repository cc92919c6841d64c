"""Batches: mega-batches of like lengths, padding to the longest row, collating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.masks import fit
from promptloom.operators.order import as_list, shuffle_rank


def length_groups(
    df: DataFrame, key, length: str, batch: int, seed: int, most: int = 50, within=()
) -> DataFrame:
    """Adds ``megabatch`` and ``pos``: random mega-batches, longest row first in each.

    A mega-batch holds ``min(rows // (4 * batch), most)`` batches, at least one.  With ``within``
    each split is grouped by itself.
    """
    size = F.least(F.floor(F.col("_total") / (4 * batch)), F.lit(most))
    size = F.greatest(size, F.lit(1)) * batch
    ranked = shuffle_rank(df, key, seed, "_rank", within, "_total").withColumn(
        "megabatch", F.floor((F.col("_rank") - 1) / size)
    )
    inside = Window.partitionBy(*as_list(within), "megabatch").orderBy(
        F.desc(length), F.asc("_rank")
    )
    return ranked.withColumn("pos", F.row_number().over(inside).cast("bigint")).drop(
        "_rank", "_total"
    )


def grouped_batch(batch: int) -> Column:
    """Batch number inside the mega-batches of ``length_groups``."""
    return F.floor((F.col("pos") - 1) / batch)


def assign_batches(rank: str, batch: int, accumulate: int) -> dict[str, Column]:
    """Micro-batch and optimizer step of a ranked row."""
    micro = F.floor((F.col(rank) - 1) / batch)
    return {"micro": micro, "step": F.floor(micro / accumulate)}


def padding_waste(df: DataFrame, batch: list[str], length: str) -> DataFrame:
    """Real and padding tokens when every batch is padded to its longest row."""
    per_batch = df.groupBy(*batch).agg(
        F.max(length).alias("_longest"), F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_sum")
    )
    return per_batch.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("_sum").alias("real_tokens"),
        F.sum(F.col("_longest") * F.col("_n") - F.col("_sum")).alias("pad_tokens"),
    )


def pad_batch(
    df: DataFrame, batch: str, ids: str, pad: int, width: str = "width", out: str = "padded"
) -> DataFrame:
    """Adds the batch's ``width`` and each row's ids padded to it.  A batch is a handful of rows."""
    widest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn(width, widest).withColumn(out, fit(ids, F.col(width), pad))


def collate(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row per batch with the rows' arrays in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    gathered = df.groupBy(batch).agg(rows.alias("_rows"))
    return gathered.select(batch, *[F.col("_rows").getField(c).alias(c) for c in columns])
