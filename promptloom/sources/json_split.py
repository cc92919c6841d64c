"""JSON arrays of records, and objects of one array per column, with one file read by many tasks.

Files are read in pieces that end in a comma, wherever that stands.  Whether it parts two elements follows from the
strings and brackets before it: a first pass reports for each block whether it turns a string on or off, and how much
deeper it leaves the brackets if it begins outside, or inside, a string.  With the state before each block known the next
pass cuts elements where commas and brackets stand at the right depth.  ``from_json`` takes them apart.

Only files whose brackets and strings close again are taken; others are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.session import cut
from promptloom.sources.readers import BROKEN
from promptloom.sources.spans import COUNT, PIECES, WHOLE, Batches, Cuts, assemble, blocks, carried, runs

_ELEMENT, _NAME = 0, 1
_MARKS = np.zeros(256, np.uint8)
_MARKS[[ord(c) for c in '",[]{}']] = 1


def _outside(text: np.ndarray, in_string: bool) -> tuple[np.ndarray, bool]:
    """Places of commas and brackets outside strings, and whether the text ends in a string."""
    at = np.flatnonzero(_MARKS[text])
    quote = text[at] == ord('"')
    slash = text == ord("\\")
    if slash.any():
        # a quote behind an odd number of backslashes is a letter of the string
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(text.size)))
        q = at[quote]
        before = np.where(q > 0, q - 1 - last_other[np.maximum(q - 1, 0)], 0)
        quote[np.flatnonzero(quote)[before % 2 == 1]] = False
        at_is_quote = text[at] == ord('"')
    else:
        at_is_quote = quote
    inside = (np.cumsum(quote) + in_string) % 2
    return at[(inside == 0) & ~at_is_quote], bool(inside[-1]) if at.size else in_string


def _steps(marks: np.ndarray) -> np.ndarray:
    return ((marks == ord("[")) | (marks == ord("{"))).astype(np.int64) - ((marks == ord("]")) | (marks == ord("}")))


def _text(pieces: pa.Array) -> bytes:
    """The pieces with the comma behind each; the one behind a file's last piece stands outside everything."""
    return b",".join([*pieces.cast(pa.binary()).to_pylist(), b""])


def _effects(batches: Batches) -> Batches:
    for (file, block), parts in runs(batches):
        ends, depths, first = [False, True], [0, 0], ""
        for (pieces,) in parts:
            data = _text(pieces)
            first = first or data.lstrip(b" \t\r\n")[:1].decode("latin-1")
            text = np.frombuffer(data, np.uint8)
            for k in (0, 1):
                at, ends[k] = _outside(text, ends[k])
                depths[k] += int(_steps(text[at]).sum())
        yield pa.record_batch(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([not ends[1]]), pa.array(depths[:1], pa.int64()), pa.array(depths[1:], pa.int64()), pa.array([first])],
            names=["file", "block", "turns", "outside", "inside", "first"],
        )


def _states(spark: SparkSession, path: str, first: str) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether a string is open, and how many brackets are, before each block."""
    schema = "file string, block bigint, turns boolean, outside bigint, inside bigint, first string"
    rows = blocks(spark, path, ",").mapInArrow(_effects, schema).collect()
    wrong = [r.file for r in rows if r.block == 0 and r.first not in (first, ",")]
    if wrong:
        raise ValueError(f"{wrong[0]} does not begin with {first}")

    def follow(state, effect):
        (in_string, depth), (turns, outside, inside) = state, effect
        return in_string != turns, depth + (inside if in_string else outside)

    before = carried([(r.file, r.block, (r.turns, r.outside, r.inside)) for r in rows], follow, (False, 0))
    broken = [file for (file, block), state in before.items() if block == -1 and state != (False, 0)]
    if broken:
        raise ValueError(f"{broken[0]} ends inside a string or bracket")
    return before


def _elements(states, level: int, ends: bool):
    """Elements of the arrays at a depth; at the second one also what stands between arrays."""

    def run(batches: Batches) -> Batches:
        for (file, block), parts in runs(batches):
            in_string, depth = states.value.get((file, block), (False, 0))
            inside = depth >= level
            # a block that begins behind a comma between elements begins with one
            cuts = Cuts(file, block, ends, continued=(depth != level or in_string) and (inside or (level > 1 and block > 0)))
            held: list[bytes] = []
            for (pieces,) in parts:
                data = _text(pieces)
                text = np.frombuffer(data, np.uint8)
                at, in_string = _outside(text, in_string)
                marks = text[at]
                steps = _steps(marks)
                depths = depth + np.cumsum(steps)
                opens = (steps > 0) & (depths == level)
                if (opens & (marks == ord("{"))).any():
                    raise ValueError(f"{file} holds an object where an array is expected")
                here = opens | ((marks == ord(",")) & (depths == level)) | ((steps < 0) & (depths == level - 1))
                depth, begin = int(depths[-1]) if at.size else depth, 0
                for end, mark in zip(at[here].tolist(), marks[here].tolist(), strict=True):
                    if inside or level > 1:
                        text_of = held, begin, end
                        text = lambda t=text_of, d=data: b"".join([*t[0], d[t[1] : t[2]]]).decode()
                        cuts.add(text, _ELEMENT if inside else _NAME, with_ends=not inside)
                    held, begin, inside = [], end + 1, mark != ord("]")
                if begin < len(data):
                    held.append(data[begin:])
                made = cuts.take()
                if made is not None:
                    yield made
            if held and (inside or level > 1):
                cuts.add(b"".join(held).decode(), _ELEMENT if inside else _NAME, last=True)
                made = cuts.take()
                if made is not None:
                    yield made
            if ends and level > 1:
                yield cuts.count()

    return run


def _cut(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, DataFrame]:
    """Whole elements, and what is not one."""
    states = spark.sparkContext.broadcast(_states(spark, path, "[" if level == 1 else "{"))
    pieces = blocks(spark, path, ",")
    return pieces.mapInArrow(_elements(states, level, ends=False), PIECES), pieces.mapInArrow(_elements(states, level, ends=True), PIECES)


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _trimmed() -> Column:
    return F.trim(F.col("value"), F.lit(" \t\r\n"))


def read_records_split(spark: SparkSession, path: str, schema: T.StructType | str, on_broken: str = "error") -> DataFrame:
    """The rows of ``read_records``: one JSON array of records a file, with a file of any size read by many tasks.

    A record that is broken inside is an error; with ``on_broken='keep'`` it is a row of nulls with its text in
    ``BROKEN``.
    """
    schema = _schema(schema)
    if on_broken not in ("error", "keep"):
        raise ValueError("on_broken is 'error' or 'keep'")
    whole, ends = _cut(spark, path, 1)
    rows = whole.select("value").unionByName(assemble(ends, "").select("value")).select(_trimmed().alias("value")).filter("value <> ''")
    if on_broken == "error":
        return rows.select(F.from_json("value", schema.json(), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    kept = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    return rows.select(F.from_json("value", kept.json(), options).alias("r")).select("r.*")


def read_columnar_split(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of files that each hold one object with an array per column, a file of any size read by many tasks.

    Every element gets its number within its array from counts of blocks; one shuffle by file and number brings the
    columns together.  A column the file lacks, or a shorter one, leaves nulls; a column that stands there twice is
    an error.
    """
    schema = _schema(schema)
    whole, ends = _cut(spark, path, 2)
    ends = cut(ends)  # two pieces and a count a block, and the names of columns
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = ends.filter(F.col("kind") == COUNT).select("file", "block", F.coalesce(F.sum("place").over(before), F.lit(0)).alias("base"))
    pieced = assemble(ends, "")
    columns = ["file", "block", "place", "label", "value"]
    named = ends.filter((F.col("kind") == WHOLE) & (F.col("label") == _NAME)).select(columns).unionByName(pieced.filter(F.col("label") == _NAME))
    found = F.regexp_extract("value", r'("(?:[^"\\]|\\.)*")\s*:\s*$', 1)
    name = F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>")[0]
    named = named.filter(found != "").join(F.broadcast(counts), ["file", "block"]).select("file", (F.col("base") + F.col("place")).alias("seq"), name.alias("name"))
    # a row a file, an entry a column
    heads = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("heads"))
    twice = F.size(F.array_distinct("heads.name")) < F.size("heads")
    heads = heads.withColumn("heads", F.when(twice, F.raise_error(F.concat("file", F.lit(" holds a column twice")))).otherwise(F.col("heads")))
    rows = whole.select(columns).unionByName(pieced.filter(F.col("label") == _ELEMENT)).withColumn("value", _trimmed()).filter("value <> ''")
    rows = rows.join(F.broadcast(counts), ["file", "block"]).withColumn("seq", F.col("base") + F.col("place"))
    head = F.element_at(F.filter("heads", lambda h: h.seq < F.col("seq")), -1)
    rows = rows.join(F.broadcast(heads), "file").select("file", "seq", "value", head.alias("head"))
    values = [F.max(F.when(F.col("head.name") == f.name, F.col("value"))).alias(f"v{k}") for k, f in enumerate(schema)]
    wide = rows.groupBy("file", (F.col("seq") - F.col("head.seq")).alias("number")).agg(*values)

    def typed(k: int, field: T.StructField) -> Column:
        whole_type = T.StructType([T.StructField("v", field.dataType)])
        boxed = F.concat(F.lit('{"v":'), F.col(f"v{k}"), F.lit("}"))
        return F.from_json(boxed, whole_type.json(), {"mode": "FAILFAST"})["v"].alias(field.name)

    return wide.select([typed(k, f) for k, f in enumerate(schema)])
