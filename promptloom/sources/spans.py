"""Records that span lines, read from files that split.

A text file is read in blocks by many tasks, each of which sees its block's pieces in order.  What a piece means
depends on what stands before it in the file: whether a quote is open, how deep the brackets are.  That state
is found in two passes: the first reports for each block what it does to the state, the running state before each block
comes from these few rows, and the second pass cuts records.  A record that runs over the end of its block is put
together from its pieces afterwards; there are at most two such pieces a block.

One row a block goes through the driver: a 100 TB table has some 800,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

#: What a row of the second pass is: a record of its own, or the end, a middle part, or the beginning of one.
#: A COUNT says in ``place`` how many records begin in the block.
WHOLE, CLOSE, MIDDLE, OPEN, COUNT = 0, 1, 2, 3, 4
PIECES = "file string, block bigint, place bigint, kind int, label int, value string"


class Cuts:
    """The records and pieces that begin or end in one block, in order.

    ``place`` counts the records that begin in the block; what belongs to a record of an earlier block has -1.  With
    ``ends`` only pieces are kept, without them only whole records.
    """

    def __init__(self, file: str, block: int, ends: bool, continued: bool):
        self.file, self.block, self.ends, self.continued = file, block, ends, continued
        self.place, self.rows = 0, []

    def add(self, value: str | Callable[[], str], label: int = 0, last: bool = False, with_ends: bool = False) -> None:
        """One more record; ``last`` is for what the end of the block cuts off.  A record ``with_ends`` is kept with the pieces."""
        kind = (MIDDLE if last else CLOSE) if self.continued else (OPEN if last else WHOLE)
        place = -1 if self.continued else self.place
        self.place += not self.continued
        self.continued = False
        if (kind != WHOLE or with_ends) == self.ends:
            self.rows.append((place, kind, label, value if isinstance(value, str) else value()))

    def add_whole(self, values: pa.Array, label: int = 0) -> pa.RecordBatch | None:
        """Records as they are, in Arrow."""
        n, at = len(values), self.place
        self.place += n
        if self.ends or not n:
            return None
        return self._batch(pa.array(range(at, at + n), pa.int64()), pa.repeat(pa.scalar(WHOLE, pa.int32()), n), pa.repeat(pa.scalar(label, pa.int32()), n), values)

    def count(self) -> pa.RecordBatch:
        self.rows.append((self.place, COUNT, 0, ""))
        return self.take()

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        place, kind, label, value = zip(*rows, strict=True)
        return self._batch(pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(value, pa.string()))

    def _batch(self, place: pa.Array, kind: pa.Array, label: pa.Array, value: pa.Array) -> pa.RecordBatch:
        n = len(value)
        where = [pa.repeat(pa.scalar(self.file), n), pa.repeat(pa.scalar(self.block, pa.int64()), n)]
        return pa.RecordBatch.from_arrays([*where, place, kind, label, value], names=["file", "block", "place", "kind", "label", "value"])


def blocks(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """``file, block, value``: the pieces of text between endings, in order within a block."""
    lines = spark.read.option("lineSep", ending).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def runs(batches: Batches, width: int = 3) -> Iterator[tuple[tuple[str, int], Iterator[list[pa.Array]]]]:
    """The stretches of rows of one block: its file and start, and the other columns in parts.

    The parts of a stretch are to be used up before the next is asked for.
    """
    state: dict = {"rest": None, "end": False}

    def pull() -> None:
        while state["rest"] is None and not state["end"]:
            batch = next(batches, None)
            if batch is None:
                state["end"] = True
            elif batch.num_rows:
                state["rest"] = batch

    def parts(key: tuple[str, int]) -> Iterator[list[pa.Array]]:
        while True:
            pull()
            batch = state["rest"]
            if batch is None:
                return
            files, starts = batch.column(0), batch.column(1)
            if (files[0].as_py(), starts[0].as_py()) != key:
                return
            n = batch.num_rows
            if (files[n - 1].as_py(), starts[n - 1].as_py()) != key:
                n = next(k for k in range(n) if (files[k].as_py(), starts[k].as_py()) != key)
            state["rest"] = batch.slice(n) if n < batch.num_rows else None
            yield [batch.column(k).slice(0, n) for k in range(2, width)]

    while True:
        pull()
        if state["rest"] is None:
            return
        key = state["rest"].column(0)[0].as_py(), state["rest"].column(1)[0].as_py()
        yield key, parts(key)


def carried(effects: list, follow: Callable, start) -> dict[tuple[str, int], object]:
    """The state before each block, from ``(file, block, effect)`` of all blocks; ``follow(state, effect)`` is the one behind it.

    The state behind a file's last block is found under the block ``-1``.
    """
    before: dict = {}
    for file, block, effect in sorted(effects):
        before[file, block] = before.get((file, -1), start)
        before[file, -1] = follow(before[file, block], effect)
    return before


def assemble(ends: DataFrame, glue: str) -> DataFrame:
    """``file, block, place, label, value`` of the records that come in pieces; ``block, place`` is where one begins.

    A beginning nobody ends, as behind the last record of a file, is no record.
    """
    # a block has two pieces at most, so a file's pieces are few beside its records
    order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("kind") == OPEN, F.struct("block", "place", "label"))
    owned = ends.filter(F.col("kind").isin(CLOSE, MIDDLE, OPEN)).withColumn("owner", F.last(opened, ignorenulls=True).over(order))
    piece = F.struct("block", "place", "value")
    joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("kind").alias("least"))
    return joined.filter(F.col("least") == CLOSE).select("file", "owner.*", F.array_join("p.value", glue).alias("value"))
