"""Writers and safe rewriting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.order import global_rank

COLUMNAR_ROWS = 4096


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; line breaks, quotes, blanks and the empty text survive."""
    df.write.mode(mode).options(
        header=True, quote='"', escape='"', nullValue="", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line; nulls are written, so every record has all columns."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's records with brackets around them and commas between."""
    yield pa.record_batch([pa.array(["["])], names=["value"])
    lead = ""
    for batch in batches:
        if batch.num_rows:
            first, rest = batch.column(0)[0].as_py(), batch.column(0).slice(1)
            yield pa.record_batch([pa.array([lead + first])], names=["value"])
            yield pa.record_batch([pc.binary_join_element_wise("", rest, ",")], names=["value"])
            lead = ","
    yield pa.record_batch([pa.array(["]"])], names=["value"])


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that hold one JSON array of records each, a record a line."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(record.alias("value")).mapInArrow(_as_array, "value string").write.mode(mode).text(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One text column as raw lines."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with one directory per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def to_columnar(df: DataFrame, order: list[Column], rows: int = COLUMNAR_ROWS) -> DataFrame:
    """``chunk`` and one array per column, at most ``rows`` rows in each.

    The chunks, and the values inside each, are in the given order; a table of any size becomes many
    objects of bounded size rather than one that no task could hold.
    """
    ranked = global_rank(df, order, "_pos")
    entries = F.array_sort(F.collect_list(F.struct("_pos", *df.columns)))
    chunks = ranked.groupBy(F.floor((F.col("_pos") - 1) / rows).alias("chunk")).agg(
        entries.alias("_rows")
    )
    return chunks.select("chunk", *[F.col("_rows").getField(c).alias(c) for c in df.columns])


def write_columnar(
    df: DataFrame, path: str, order: list[Column], rows: int = COLUMNAR_ROWS,
    mode: str = "errorifexists",
) -> None:
    """Columnar JSON: one object of arrays per line."""
    columnar = to_columnar(df, order, rows).drop("chunk")
    columnar.write.mode(mode).option("ignoreNullFields", False).json(path)


def convert(
    read: Callable[[], DataFrame], write: Callable[[DataFrame, str], None], target: str
) -> None:
    """A format conversion: any reader here into any writer here."""
    write(read(), target)


def rewrite(
    spark: SparkSession, path: str, read: Callable[[str], DataFrame],
    change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], None],
) -> str:
    """Replaces the data at ``path`` by a changed version; returns where the old version is.

    The new version is written beside the old one and takes its place by two renames once it is
    complete, so nobody ever sees half of it.  Between the renames the path is absent for a moment,
    and on an object store a rename copies: readers that run meanwhile should retry.  The old version
    stays until the caller deletes it.
    """
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    fresh, former = f"{path}.new-{mark}", f"{path}.old-{mark}"
    write(change(read(path)), fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, there, back = hadoop.Path(path), hadoop.Path(fresh), hadoop.Path(former)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(here, back):
        raise OSError(f"could not set {path} aside")
    if not files.rename(there, here):
        files.rename(back, here)
        raise OSError(f"could not put the new version at {path}")
    return former
