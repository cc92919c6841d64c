"""How long texts are: exact quantiles, a sketch that merges, and the shares a limit would cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.operators.order import as_list

QUANTILES = (0.5, 0.9, 0.95, 0.99, 1.0)


def length_counts(df: DataFrame, by, length: Column) -> DataFrame:
    """``by, length, n``: how many rows are how long.  Rows without a length are left out.

    D distinct lengths need texts of D * D / 2 tokens in all, so this stays small however many rows there are.
    """
    by = as_list(by)
    rows = df.select(*by, length.cast("bigint").alias("length")).filter(F.col("length").isNotNull())
    return rows.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"))


def length_quantiles(df: DataFrame, by, length: Column, shares=QUANTILES) -> DataFrame:
    """``by, share, length, longer``: the shortest length that a share of the rows does not exceed, exactly, and how many
    rows are longer still, which a limit of that length would cut.
    """
    by = as_list(by)
    if not all(0 < s <= 1 for s in shares):
        raise ValueError("a share is above 0 and at most 1")
    upto = Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = length_counts(df, by, length)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*by))})
    # ceil of a product of an exact decimal, not of its nearest double
    wanted = F.explode(F.array(*[F.lit(str(s)).cast("decimal(18, 17)") for s in shares])).alias("share")
    each = ranked.select(*by, "length", "n", "upto", "total", wanted)
    need = F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1))
    here = each.filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
    return here.select(*by, F.col("share").cast("double").alias("share"), "length", (F.col("total") - F.col("upto")).alias("longer"))


def length_sketch(df: DataFrame, by, length: Column, k: int = 200) -> DataFrame:
    """``by, sketch``: a KLL sketch of the lengths, of bounded size; its rank error is about 1.3 % at ``k`` = 200.

    Sketches of parts, days or sources add up by ``merge_sketches`` without reading a text again.
    """
    return df.groupBy(*as_list(by)).agg(F.kll_sketch_agg_bigint(length.cast("bigint"), F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by, k: int = 200) -> DataFrame:
    return sketches.groupBy(*as_list(by)).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by, shares=QUANTILES) -> DataFrame:
    """``by, share, length`` from sketches."""
    found = [
        F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(s))).alias("length"))
        for s in shares
    ]
    return sketches.select(*as_list(by), F.inline(F.array(*found)))
