"""Column selection, cleaning and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions.text import NA_TOKENS

# The columns whose names differ between the two chat corpus layouts.
LAYOUT_RENAMES = {"usr_prompt": "user_prompt", "code_content": "file_content"}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    return require(df, columns).select(*columns)


def drop_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drops columns; unlike ``DataFrame.drop`` a missing one is an error."""
    return require(df, columns).drop(*columns)


def isolate(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value; a plain comparison, so parquet gets it as a pushed filter."""
    return df.filter(F.col(column) == F.lit(value))


def drop_null(
    df: DataFrame, columns: list[str] | None = None, na_tokens: list[str] | None = None
) -> DataFrame:
    """Rows without a null in ``columns``, after NaN and strings such as ``NA`` count as null.

    ``NONE`` in capitals is not such a string.
    """
    columns = columns or df.columns
    na = NA_TOKENS if na_tokens is None else na_tokens
    textual = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}

    def there(c: str) -> Column:
        if c in floating:
            return F.col(c).isNotNull() & ~F.isnan(c)
        return F.col(c).isNotNull() & ~F.col(c).isin(na) if c in textual and na else F.col(c).isNotNull()

    present = [there(c) for c in columns]
    for condition in present:
        df = df.filter(condition)
    return df


def stringify(df: DataFrame, columns: list[str] | None = None, null_as: str = "None") -> DataFrame:
    """Casts columns to string; a null becomes the text ``null_as``."""
    columns = columns or df.columns
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(null_as)) for c in columns}
    )


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls and text lengths of each column: one pass, one row per column."""
    columns = columns or df.columns
    length = {c: F.length(F.col(c).cast("string")) for c in columns}
    measured = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"{c}#n") for c in columns],
        *[F.min(length[c]).alias(f"{c}#min") for c in columns],
        *[F.avg(length[c]).alias(f"{c}#avg") for c in columns],
        *[F.max(length[c]).alias(f"{c}#max") for c in columns],
    )

    def line(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("column_name"),
            F.col("_rows").alias("n_rows"),
            (F.col("_rows") - F.col(f"`{c}#n`")).alias("n_nulls"),
            F.col(f"`{c}#min`").cast("bigint").alias("min_length"),
            F.round(f"`{c}#avg`", 6).alias("avg_length"),
            F.col(f"`{c}#max`").cast("bigint").alias("max_length"),
        )

    return measured.select(F.inline(F.array(*[line(c) for c in columns])))


def harmonise(
    df: DataFrame, renames: dict[str, str] | None = None, expected: list[str] | None = None
) -> DataFrame:
    """Old column names to new ones, then a check that all ``expected`` columns are there."""
    out = df.withColumnsRenamed(LAYOUT_RENAMES if renames is None else renames)
    return require(out, expected) if expected else out


def log_every(df: DataFrame, step: str, n: int) -> DataFrame:
    """The steps that are logged when every ``n``-th is."""
    return df.filter(F.col(step) % n == 0)
