"""CSV with line breaks inside quoted cells, one file read by many tasks.

A line break ends a record where the number of quotes before it in the file is even.  A first pass sums quotes by
block on the JVM; with that the next one cuts the lines of its block into records, which ``from_csv`` takes apart.

This holds for files in which quotes stand around cells, and doubled inside them, and nowhere else.  A file
whose quotes do not pair is an error; one with pairs of quotes in the middle of unquoted cells is to be read by
``read_csv``.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.sources.readers import CSV_OPTIONS
from promptloom.sources.spans import PIECES, Batches, Cuts, assemble, blocks, carried, runs

_HEADER = 1


def _quotes(spark: SparkSession, path: str) -> dict[tuple[str, int], int]:
    """Whether a quote is open before each block: 1 or 0."""
    counted = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = blocks(spark, path, "\n").groupBy("file", "block").agg((F.sum(counted) % 2).cast("int").alias("odd"))
    before = carried([tuple(r) for r in sums.collect()], lambda state, odd: state ^ odd, 0)
    broken = [file for (file, block), odd in before.items() if block == -1 and odd]
    if broken:
        raise ValueError(f"the quotes of {broken[0]} do not pair")
    return before


def _records(odd_before, ends: bool):
    """Pieces of records, or the whole ones; the first record of a file is its header."""

    def run(batches: Batches) -> Batches:
        for (file, block), parts in runs(batches):
            odd = odd_before.value.get((file, block), 0)
            cuts, held = Cuts(file, block, ends, continued=bool(odd)), []
            for (lines,) in parts:
                behind = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + odd) % 2
                odd = int(behind[-1])
                if not behind.any() and not held and not cuts.continued and (cuts.place or block):
                    made = cuts.add_whole(lines)  # every line is a record
                    if made is not None:
                        yield made
                    continue
                at = 0
                for end in np.flatnonzero(behind == 0).tolist():
                    text = held, lines.slice(at, end + 1 - at)
                    cuts.add(lambda t=text: "\n".join([*t[0], *t[1].to_pylist()]), _HEADER if block == 0 and cuts.place == 0 else 0)
                    held, at = [], end + 1
                held = held + lines.slice(at).to_pylist()
                made = cuts.take()
                if made is not None:
                    yield made
            if held:
                cuts.add("\n".join(held), _HEADER if block == 0 and cuts.place == 0 else 0, last=True)
                made = cuts.take()
                if made is not None:
                    yield made

    return run


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of ``read_csv``, with a file of any size read by many tasks.

    Empty lines between records are no records; a record too short or too long for the schema is taken as there.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    odd = spark.sparkContext.broadcast({key: 1 for key, value in _quotes(spark, path).items() if value})
    lines = blocks(spark, path, "\n")
    whole = lines.mapInArrow(_records(odd, ends=False), PIECES).select("label", "value")
    pieced = assemble(lines.mapInArrow(_records(odd, ends=True), PIECES), "\n").select("label", "value")
    record = F.regexp_replace("value", "\r$", "")
    rows = whole.unionByName(pieced).filter(F.col("label") != _HEADER).select(record.alias("value")).filter("value <> ''")
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"}
    return rows.select(F.from_csv("value", schema.toDDL(), options).alias("r")).select("r.*")
