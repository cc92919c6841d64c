"""Token vocabulary, encoding and decoding as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from promptloom.operators.order import as_list, global_rank
from promptloom.operators.parts import ENTRIES, in_parts, spans
from promptloom.session import cut

SPECIALS = ["<pad>", "<unk>", "<eos>"]
PAD, UNK, EOS = 0, 1, 2

# The most frequent tokens are looked up by broadcast: at most 262,144 rows of at most 64
# characters, a few MB of ordinary words.
HEAD = 1 << 18
HEAD_LENGTH = 64


def build_vocab(df: DataFrame, toks: Column, max_size: int | None = None) -> DataFrame:
    """``id, token, freq``: the special tokens, then all others by frequency and token.

    Text that reads like a special token gets an id of its own, so that nothing in a text can pass
    for padding or for its end.  ``max_size`` bounds the vocabulary as a tokenizer's size does; the default keeps every token.
    """
    counts = (
        df.select(F.explode(toks).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    ranked = global_rank(counts, [F.desc("freq"), F.asc("token")], "rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("rank") <= max_size - len(SPECIALS))
    names = F.array(*[F.lit(s) for s in SPECIALS])
    special = df.sparkSession.range(len(SPECIALS)).select(
        F.col("id").cast("int").alias("id"), F.get(names, F.col("id")).alias("token"),
        F.lit(0).cast("bigint").alias("freq"),
    )
    ids = ranked.select(
        (F.col("rank") - 1 + len(SPECIALS)).cast("int").alias("id"), "token", "freq"
    )
    return special.unionByName(ids)


def _is_head() -> Column:
    return (F.col("id") < HEAD) & (F.length("token") <= HEAD_LENGTH)


def _head(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """The head's ids and tokens without the special ones: HEAD rows at most, as arrays, which workers hold in a few MB."""
    rows = vocab.filter(_is_head() & (F.col("id") >= len(SPECIALS))).select("id", "token").toArrow().combine_chunks()
    return tuple(pa.concat_arrays([pa.array([], kind), *rows.column(c).cast(kind).chunks]) for c, kind in (("id", pa.int32()), ("token", pa.string())))


def _tail(vocab: DataFrame) -> DataFrame:
    rest = vocab.filter(~_is_head() & (F.col("id") >= len(SPECIALS)))
    return rest.select(F.col("id").alias("_id"), F.col("token").alias("_token"))


def _keyed(df: DataFrame, key: list[str], *columns: Column) -> DataFrame:
    """The key, which must not be null, and some columns."""
    failure = F.raise_error(F.lit("null key: " + ", ".join(key)))
    return df.select(*[F.coalesce(F.col(c), failure).alias(c) for c in key], *columns)


def _places(lengths: np.ndarray, missing: np.ndarray, values: list) -> tuple[np.ndarray, list[list]]:
    """For entries the head lacks: which of its row's distinct ones each is, and these by row."""
    rows = np.repeat(np.arange(lengths.size), lengths)[missing]
    distinct: list[dict] = [{} for _ in range(lengths.size)]
    at = [distinct[r].setdefault(v, len(distinct[r])) for r, v in zip(rows.tolist(), values, strict=True)]
    return np.asarray(at, np.int32), [list(d) for d in distinct]


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _numbered(batches: Iterator[pa.RecordBatch], head_ids: pa.Array, known: pa.Array) -> Iterator[pa.RecordBatch]:
    """Arrays of tokens, the last column, as ``_ids``, and as ``_tail`` what the head lacks."""
    ids = head_ids.to_numpy()
    for batch in in_parts(batches):
        lists = batch.column(batch.num_columns - 1)
        values, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy()
        coded = np.where(at >= 0, ids[at] if ids.size else 0, 0).astype(np.int32)
        missing = np.flatnonzero(at < 0)
        place, tail = _places(lengths, missing, values.take(pa.array(missing)).to_pylist())
        coded[missing] = -1 - place
        columns = [*batch.columns[:-1], pa.ListArray.from_arrays(_offsets(lengths), pa.array(coded)), pa.array(tail, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_ids", "_tail"])


def _worded(batches: Iterator[pa.RecordBatch], head_ids: pa.Array, known: pa.Array, skip_special: bool) -> Iterator[pa.RecordBatch]:
    """Arrays of ids, the last column, as ``_toks``, with places ``_at`` in ``_tail`` of those the head lacks."""
    numbers = pa.concat_arrays([pa.array(range(len(SPECIALS)), pa.int32()), head_ids])
    names = pa.concat_arrays([pa.array(SPECIALS, pa.string()), known])
    for batch in in_parts(batches):
        lists = batch.column(batch.num_columns - 1)
        values, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        if skip_special:
            special = pc.fill_null(pc.is_in(values, value_set=pa.array(range(len(SPECIALS)), pa.int32())), False)
            kept = ~special.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(lengths.size), lengths)[kept]
            values, lengths = values.filter(pa.array(kept)), np.bincount(row, minlength=lengths.size)
        values = pc.fill_null(values, -1)
        at = pc.index_in(values, value_set=numbers)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        place, tail = _places(lengths, missing, values.take(pa.array(missing)).to_pylist())
        where = np.full(len(values), -1, np.int32)
        where[missing] = place
        offsets = _offsets(lengths)
        columns = [
            *batch.columns[:-1], pa.ListArray.from_arrays(offsets, names.take(at)),
            pa.ListArray.from_arrays(offsets, pa.array(where)), pa.array(tail, pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_toks", "_at", "_tail"])


def _found(coded: DataFrame, key: list[str], tail: DataFrame, by: str, want: str, unknown) -> DataFrame:
    """``key, _found``: what the tail of the vocabulary has for each row's distinct entries, in order.

    Only these entries are shuffled, once for each row; a join Spark may split where one is in very
    many rows.
    """
    asked = coded.select(*key, F.posexplode("_tail").alias("_k", by)).join(tail, by, "left")
    entry = F.struct("_k", F.coalesce(F.col(want), F.lit(unknown)).alias("v"))
    gathered = asked.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return gathered.select(*key, F.col("_e.v").alias("_found"))


def _filled(coded: DataFrame, key: list[str], tail: DataFrame, by: str, want: str, unknown) -> DataFrame:
    """``coded`` with ``_found``.  It is kept, so that the look-up runs once; rows the head sufficed for do not move."""
    coded = cut(coded)
    asked = coded.filter(F.size("_tail") > 0)
    there = asked.drop("_tail").join(_found(asked, key, tail, by, want, unknown), key, "left")
    return there.unionByName(coded.filter(F.size("_tail") == 0).drop("_tail"), allowMissingColumns=True)


def _schema(df: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != "_in"), *added])


def encode(
    df: DataFrame, key, toks: Column, vocab: DataFrame, out: str = "ids", tags: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``key, out``: the ids of each row's token array, unknown tokens as ``<unk>``.

    ``key`` is unique; a null in it is an error.  ``tags`` is an optional parallel array that comes
    back as ``tags``, ``carry`` names columns that come back as they are.  A token that reads like a
    special one is a token like any other.  The head of the vocabulary is looked up inside the row,
    in Arrow batches; only each row's distinct other tokens are shuffled, and nothing where the head is all of it.
    """
    key, carry = as_list(key), carry or []
    extra = [F.col(c) for c in carry] + ([tags.alias("tags")] if tags is not None else [])
    rows = _keyed(df, key, *extra, F.coalesce(toks, F.array().cast("array<string>")).alias("_in"))
    shipped = df.sparkSession.sparkContext.broadcast(_head(vocab))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(batches, *shipped.value)

    numbers, texts = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    coded = rows.mapInArrow(look_up, _schema(rows, T.StructField("_ids", numbers), T.StructField("_tail", texts)))
    names = key + carry + (["tags"] if tags is not None else [])
    tail = _tail(vocab)
    if tail.isEmpty():  # what the head lacks, the vocabulary does
        return coded.select(*names, F.transform("_ids", lambda x: F.when(x >= 0, x).otherwise(UNK)).alias(out))
    both = _filled(coded, key, tail, "_token", "_id", UNK)
    filled = F.transform("_ids", lambda x: F.when(x >= 0, x).otherwise(F.get("_found", -1 - x)))
    return both.select(*names, filled.alias(out))


def decode(
    df: DataFrame, key, ids: str, vocab: DataFrame, out: str = "text", skip_special: bool = True
) -> DataFrame:
    """``key, out``: the tokens of each id array joined by blanks, special ones left out.

    An id the vocabulary lacks, or a null one, reads ``<unk>``.
    """
    key = as_list(key)
    empty = F.array().cast("array<int>")
    rows = _keyed(df, key, F.coalesce(F.col(ids).cast("array<int>"), empty).alias("_in"))
    shipped = df.sparkSession.sparkContext.broadcast(_head(vocab))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _worded(batches, *shipped.value, skip_special)

    numbers, texts = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    read = rows.mapInArrow(
        look_up, _schema(rows, T.StructField("_toks", texts), T.StructField("_at", numbers), T.StructField("_tail", numbers))
    )
    tail = _tail(vocab)
    if tail.isEmpty():
        return read.select(*key, F.array_join("_toks", " ", SPECIALS[UNK]).alias(out))
    both = _filled(read, key, tail, "_id", "_token", SPECIALS[UNK])
    filled = F.zip_with("_toks", "_at", lambda t, k: F.coalesce(t, F.get("_found", k)))
    return both.select(*key, F.array_join(filled, " ").alias(out))


def encode_with(make: Callable[[], Callable[[str], Iterable[int]]], text) -> Column:
    """Ids from any other codec, in Arrow batches, of a bounded part of the texts at a time.

    ``make`` is called once per task on the executor, so a codec need not be serialisable and may be
    costly to load.
    """

    @pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _coded(batches, make())

    return run(text)


def _coded(batches: Iterator[pd.Series], codec: Callable[[str], Iterable[int]]) -> Iterator[pd.Series]:
    for texts in batches:
        sizes = texts.map(lambda t: 0 if t is None else len(t)).to_numpy(np.int64)
        for first, last in spans(sizes, ENTRIES) if len(texts) else [(0, 0)]:
            yield texts.iloc[first:last].map(lambda t: None if t is None else np.fromiter(codec(t), np.int32))


def utf8_bytes() -> Callable[[str], Iterable[int]]:
    """A codec for tests: the UTF-8 bytes of the text."""
    return lambda text: text.encode("utf-8")
