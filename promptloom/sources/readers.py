"""Readers.  Every schema is declared; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.order import head

# Text cells may hold line breaks, quotes and surrounding blanks.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    # an unquoted empty cell is null, a quoted one the empty text
    "nullValue": "\u0000", "emptyValue": "",
}


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# the column that holds a record Spark could not read
BROKEN = "_broken"


def _json(spark: SparkSession, path: str, schema, multi_line: bool, on_broken: str) -> DataFrame:
    schema = _schema(schema)
    reader = spark.read.option("multiLine", multi_line)
    if on_broken == "error":
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    if on_broken != "keep":
        raise ValueError("on_broken is 'error' or 'keep'")
    kept = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    return reader.schema(kept).option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_records(spark: SparkSession, path: str, schema, on_broken: str = "error") -> DataFrame:
    """Files that hold one JSON array of records each; a file is read by one task.

    A broken record is an error; with ``on_broken='keep'`` it is a row of nulls with its text in
    ``BROKEN``.
    """
    return _json(spark, path, schema, True, on_broken)


def read_jsonl(spark: SparkSession, path: str, schema, on_broken: str = "error") -> DataFrame:
    """One JSON record per line; splits at any size.  Broken lines as in ``read_records``."""
    return _json(spark, path, schema, False, on_broken)


def read_columnar(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """JSON objects that hold one array per column.

    ``write_columnar`` puts one object of bounded size on each line; ``multi_line`` reads a
    foreign file that is a single object, which is one row until it is taken apart here.
    """
    schema = _schema(schema)
    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])
    objects = spark.read.schema(arrays).option("multiLine", multi_line).json(path)
    return objects.select(F.inline(F.arrays_zip(*[F.col(f"`{f.name}`") for f in schema])))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header; a file is read by one task, since quoted cells may hold line breaks.

    An empty unquoted cell is null, a quoted one the empty text.
    """
    return spark.read.schema(_schema(schema)).options(**CSV_OPTIONS).csv(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every column as text."""
    return read_csv(
        spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns])
    )


def read_text_tree(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """Whole files as ``folder, name, value``, where the folder is the one right above.

    A file is read by one task.  Names are as on disk, blanks and ``#`` included.  With an
    ``extension`` only files that end in it are read, and their names come without it: so prompts
    ``k.txt`` pair with answers ``k``, read by ``extension=''``, which takes files without a dot.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    # a plus stands for itself in a path; url_decode would make it a blank
    location = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = files.select(
        F.regexp_extract(location, "([^/]+)/[^/]*$", 1).alias("folder"),
        F.regexp_extract(location, "([^/]*)$", 1).alias("name"), "value",
    )
    if extension is None:
        return rows
    if not extension:
        return rows.filter(~F.contains("name", F.lit(".")))
    stem = F.substr("name", F.lit(1), F.length("name") - len(extension))
    return rows.filter(F.endswith("name", F.lit(extension))).withColumn("name", stem)


def read_dataset(spark: SparkSession, path: str, schema, split: str | None = None) -> DataFrame:
    """Parquet written by ``write_dataset``; ``split`` prunes to one directory."""
    schema = _schema(schema)
    if "split" not in schema.names:
        schema = T.StructType(schema.fields + [T.StructField("split", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_declared(
    spark: SparkSession, config: dict, schema, order: list[Column] | None = None
) -> dict[str, DataFrame]:
    """The named splits a run's settings ask for.

    ``config`` has ``path``, and by purpose the split names ``dataset`` and ``eval_dataset``; a
    missing purpose is left out of the result.  ``max_samples`` keeps that many rows of each split,
    the first in ``order``.
    """
    named = {}
    for purpose in ("dataset", "eval_dataset"):
        if config.get(purpose):
            rows = read_dataset(spark, config["path"], schema, config[purpose])
            if config.get("max_samples"):
                rows = head(rows, config["max_samples"], order or [F.col(rows.columns[0])])
            named[purpose] = rows
    return named
