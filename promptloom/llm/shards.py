"""Sharding by sampled splitters, with shards of near equal bytes.

Rows are ordered by a key that puts equal texts side by side.  A size-weighted sample of keys gives
quantile boundaries, which cut the order into many ranges; the ranges' exact sizes are counted, and
ranges that came out overfull are subdivided by a sample of their own.  Running totals inside the
ranges, on top of the totals of the ranges before, place every row to the byte, so that a shard
ends within one row of its even share.

Texts are read once: all else runs on rows of four numbers, kept in the shared folder.  Repeated
rows are counted together before anything is dealt out, so no key holds more than one narrow row
of them.  The driver sees totals, at most ``SAMPLES`` expected keys a range, and one line a range.

Defined results: size is the UTF-8 bytes of the text plus 1, so a null or empty text has size 1;
null and repeated ids are rows like others; equal rows are told apart only by their slots; shards
may stay empty when there are fewer rows than shards; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.session import cut

#: Ranges a shard, rows a range, and ranges at most; expected sampled keys a range.
RANGES, RANGE_ROWS, MOST_RANGES, SAMPLES = 16, 500_000, 65_536, 32
#: A range of more than this many even shares is subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 2.0, 4


def _measure(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each different row: id, size, checksum, key, and how many there are."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    identity = F.col(id_column)
    # equal texts share the high bits; the low bits deal a hot text's rows over many key values
    key = F.shiftleft(F.shiftright(F.xxhash64(text), 24), 24) + F.xxhash64(identity).bitwiseAND(F.lit((1 << 24) - 1))
    rows = docs.select(
        identity.alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("crc"), key.alias("key")
    )
    return rows.groupBy("id", "size", "crc", "key").agg(F.count(F.lit(1)).alias("copies"))


def _range_of(key, splitters: np.ndarray):
    @F.pandas_udf("int")
    def search(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right").astype("int32"))

    return search(key)


def _sample(items: DataFrame, keys_per_byte: float, seed: int) -> pd.DataFrame:
    """Keys drawn in proportion to their bytes, with the bytes each one stands for."""
    draw = F.xxhash64("key", "id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    weight = F.col("size") * F.col("copies")
    share = F.least(F.lit(1.0), weight * F.lit(keys_per_byte))
    return items.filter(draw < share).select("key", (weight / share).alias("weight")).toPandas()


def _quantiles(sample: pd.DataFrame, parts: int) -> np.ndarray:
    ordered = sample.sort_values("key")
    reached = ordered["weight"].cumsum().to_numpy()
    if not reached.size or parts < 2:
        return np.empty(0, np.int64)
    at = np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)
    return np.unique(ordered["key"].to_numpy(np.int64)[at])


def _totals(items: DataFrame, splitters: np.ndarray) -> pd.DataFrame:
    """Bytes and rows of every range; one line a range."""
    dealt = items.withColumn("range", _range_of(F.col("key"), splitters))
    found = dealt.groupBy("range").agg(
        F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")
    )
    return found.toPandas().sort_values("range")


def splitters(items: DataFrame, total: int, parts: int) -> np.ndarray:
    """Boundaries of the ranges, overfull ranges subdivided."""
    even = total / parts
    bounds = _quantiles(_sample(items, SAMPLES * parts / total, 0), parts)
    for turn in range(1, ROUNDS + 1):
        sizes = _totals(items, bounds)
        over = sizes[(sizes["bytes"] > OVERFULL * even) & (sizes["least"] < sizes["most"])]
        if over.empty:
            break
        full = [int(r) for r in over["range"]]
        heavy = items.withColumn("range", _range_of(F.col("key"), bounds)).filter(F.col("range").isin(full))
        sample = _sample(heavy.drop("range"), 4 * SAMPLES / even, turn)
        where = np.searchsorted(bounds, sample["key"].to_numpy(np.int64), side="right")
        fresh = [
            _quantiles(sample[where == r], int(np.ceil(size / even)) + 1) for r, size in zip(over["range"], over["bytes"], strict=True)
        ]
        wider = np.unique(np.concatenate([bounds, *fresh]))
        if wider.size == bounds.size:
            break
        bounds = wider
    return bounds


def shard(docs: DataFrame, shards: int = 8, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot in the shard, grown_shard (null)."""
    items = cut(_measure(docs, id_column, text_column))
    total, rows = items.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parts = min(MOST_RANGES, max(RANGES * shards, -(-rows // RANGE_ROWS)))
    bounds = splitters(items, total, parts) if total else np.empty(0, np.int64)
    sizes = _totals(items, bounds)
    sizes["bytes_before"] = sizes["bytes"].cumsum() - sizes["bytes"]
    sizes["rows_before"] = sizes["rows"].cumsum() - sizes["rows"]
    before = docs.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in sizes[["range", "bytes_before", "rows_before"]].to_numpy()],
        "range int, bytes_before long, rows_before long",
    )
    running = Window.partitionBy("range").orderBy("key", "crc", "size", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        items.withColumn("range", _range_of(F.col("key"), bounds))
        .withColumn("bytes_to", F.sum(F.col("size") * F.col("copies")).over(running))
        .withColumn("rows_to", F.sum("copies").over(running))
        .join(F.broadcast(before), "range")  # one line a range, at most MOST_RANGES and those of subdivided ones
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("begin", F.col("bytes_before") + F.col("bytes_to") - F.col("size") * (F.col("copies") - F.col("copy")))
        .withColumn("place", F.col("rows_before") + F.col("rows_to") - F.col("copies") + F.col("copy"))
        .withColumn("shard", F.expr(f"cast((begin * 2 + size) * {shards} div {2 * max(total, 1)} as int)"))
        .select("id", "size", "crc", "shard", "place")
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(  # one line a shard
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
