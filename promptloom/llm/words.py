"""Words and word n-grams as Column expressions, for the operators that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is small enough to be sent to every executor.
SMALL = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs without white space; none of null or empty text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def each_place(n: Column) -> Column:
    """0 to n - 1, one row each; no row for n below 1."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))


def gram(array: str, at: str, width: int) -> Column:
    """The hash of ``width`` words from a place on."""
    return F.xxhash64(*[F.col(array)[F.col(at) + k] for k in range(width)])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join: broadcast if its counted rows are few, else left to Spark."""
    return F.broadcast(df) if rows <= SMALL else df
