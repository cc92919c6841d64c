"""Order, ranks and exact splits without a window over the whole table.

Spark puts a window without ``partitionBy`` into one task.  Here every rank comes from two levels:
rows are ranked inside small buckets and the running totals of the buckets, a table of bounded
size, are added.  Random order is the order of ``md5(seed:key)``, so it is the same on every run,
with every number of partitions and after any lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.session import cut

# Four hex digits of a hash: at most 65,536 buckets, whatever the data.
BUCKET_DIGITS = 4
# Bits monotonically_increasing_id leaves for the position in a partition.
_POSITION_BITS = 33
# A key is hot when it holds more than this share of the rows, so at most 1,000 keys are.
HOT_SHARE = 1000
HOT_COPIES = 64
# Stretches in which the keys of a prefix are counted.
STRETCHES = 1 << 16


def as_list(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def hash_order(key, seed: int) -> Column:
    """The pseudo-random order of a row, from its unique key.

    The parts of a key of several columns carry their lengths, and a null a mark of its own, so no
    two keys look alike.
    """
    parts = [F.col(c).cast("string") for c in as_list(key)]
    if len(parts) == 1:
        text = F.coalesce(parts[0], F.lit("\u0000"))
    else:
        marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
        text = F.concat_ws(",", *marked)
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def running_totals(buckets: DataFrame, order: str, count: str, within=()) -> DataFrame:
    """Adds ``before`` and ``all_rows`` to a bucket table.

    Without ``within`` the window has one partition on purpose: a bucket table is bounded by the
    number of buckets.
    """
    every = Window.partitionBy(*within)
    upto = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumns(
        {
            "before": F.coalesce(F.sum(count).over(upto), F.lit(0)),
            "all_rows": F.sum(count).over(every),
        }
    )


def shuffle_rank(
    df: DataFrame, key, seed: int, rank: str = "rank", within=(), total: str | None = None
) -> DataFrame:
    """Position 1..n of each row in the seeded random order of its unique ``key``.

    ``within`` names columns of a few values, such as the split, that are ranked apart; ``total``
    also adds the number of rows ranked together.
    """
    within = as_list(within)
    keyed = df.withColumn("_hash", hash_order(key, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    sizes = keyed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(sizes, "_bucket", "_n", within).drop("_n")
    inside = Window.partitionBy(*within, "_bucket").orderBy("_hash", *as_list(key))
    ranked = (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(totals), [*within, "_bucket"])  # at most 65,536 rows for each split
        .withColumn(rank, F.col("before") + F.col("_inside"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("all_rows"))
    return ranked.drop("_hash", "_bucket", "_inside", "before", "all_rows")


def stamped_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The sorted rows with ``_at``, which grows with the order, and ``_task``, the stretch they are in.

    They are checkpointed, so that whatever is computed from them sees the same stretches, also when
    a task is run again.
    """
    stamped = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    return stamped.withColumn("_task", F.shiftright("_at", _POSITION_BITS))


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Position 1..n of each row in a total order.

    The sorted rows are range-partitioned, so a value that fills a third of the table is spread by
    the later order columns.
    """
    stamped = stamped_order(df, order)
    sizes = stamped.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(sizes, "_task", "_n").select("_task", "before")
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        stamped.join(F.broadcast(totals), "_task")  # one row per sort partition
        .withColumn(rank, F.col("before") + position + 1)
        .drop("_at", "_task", "before")
    )


def rank_within(
    df: DataFrame, group, value: Column, tie, rank: str = "rank", row_id=None
) -> DataFrame:
    """SQL ``rank()`` of ``value``, nulls last, inside ``group``, for groups of any size.

    ``tie`` names columns that make the order total.
    """
    group, tie = as_list(group), as_list(tie)
    # structs, since a null group or value is a value like any other here and equals itself
    valued = df.withColumns(
        {"_group": F.struct(*group), "_place": F.struct(*group, value.alias("_value"))}
    )
    in_order = [F.asc(c) for c in group] + [F.asc_nulls_last("_place._value")]
    ordered = global_rank(valued, in_order + [F.asc(c) for c in tie], "_pos")
    place_start = ordered.groupBy("_place").agg(F.min("_pos").alias("_place_start"))
    group_start = ordered.groupBy("_group").agg(F.min("_pos").alias("_group_start"))
    row_id = as_list(row_id or group + tie)
    out = skew_join(ordered, place_start, ["_place"], row_id)
    out = skew_join(out, group_start, ["_group"], row_id)
    return out.withColumn(rank, F.col("_place_start") - F.col("_group_start") + 1).drop(
        "_group", "_place", "_pos", "_place_start", "_group_start"
    )


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], row_id: list[str], how: str = "inner"
) -> DataFrame:
    """Join against a table unique in ``keys`` when a few keys may fill most of ``left``.

    Keys above a thousandth of the rows, at most 1,000 by count, get ``HOT_COPIES`` copies on
    the right and are spread over them on the left; every other key keeps one.
    """
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    hot = counted.filter(F.col("_n") * HOT_SHARE > total).select(
        *keys, F.lit(HOT_COPIES).alias("_copies")
    )
    hot = F.broadcast(hot)
    copies = F.coalesce("_copies", F.lit(1))
    spread = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_id), copies).cast("int")
    ).drop("_copies")
    copied = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), copies - 1))
    ).drop("_copies")
    return spread.join(copied, keys + ["_salt"], how).drop("_salt")


def keyed_rank(
    df: DataFrame, key: str, order: str, rank: str = "rank", span: int = 1 << 20
) -> DataFrame:
    """Position 1..n of each row inside its key, for keys of any size.

    ``order`` is an integer, unique inside a key.  Rows are ranked inside stretches of ``span``
    order values; the stretches' running totals are tiny beside the rows.
    """
    # a struct, so that a null key is a key like any other
    cut_up = df.withColumns({"_key": F.struct(key), "_stretch": F.floor(F.col(order) / span)})
    sizes = cut_up.groupBy("_key", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    upto = (
        Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "_key", "_stretch", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_key", "_stretch").orderBy(order)
    return (
        cut_up.join(starts, ["_key", "_stretch"])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_key", "_stretch", "_before")
    )


def moving_average(
    df: DataFrame, key: str, order: str, value: str, width: int, out: str = "moving",
    block: int = 1 << 16, span: int = 1 << 20,
) -> DataFrame:
    """Mean of the last ``width`` values of the same key, the row's own included.

    Rows of a key are cut into blocks by rank and each block also gets the ``width - 1`` rows
    before it, so no task ever holds more than a block and those.
    """
    ranked = keyed_rank(df, key, order, "_pos", span).withColumn(
        "_block", F.floor((F.col("_pos") - 1) / block)
    )
    last = F.floor((F.col("_pos") + F.lit(width - 2)) / block)  # of the last row whose mean it is in
    copied = ranked.withColumn("_home", F.explode(F.sequence(F.col("_block"), last)))
    frame = (
        Window.partitionBy(key, "_home").orderBy("_pos").rowsBetween(-(width - 1), Window.currentRow)
    )
    return (
        copied.withColumn(out, F.avg(value).over(frame))
        .filter(F.col("_home") == F.col("_block"))
        .drop("_pos", "_block", "_home")
    )


def head(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)


def prefix_share(df: DataFrame, parts: int, key: str) -> DataFrame:
    """The first ``int(rows / parts)`` rows by a unique whole-number ``key``, at any size.

    Keys are counted in even stretches of their range; only the stretch that holds the bound is
    sorted.  The rows themselves are filtered by that bound, which reaches the scan.
    """
    keys = df.select(F.col(key).cast("long").alias("_k")).filter(F.col("_k").isNotNull())
    ends = keys.agg(F.min("_k").alias("low"), F.max("_k").alias("high"))
    span = F.greatest(F.lit(1), F.ceil((ends.select("high").scalar() - ends.select("low").scalar() + 1) / STRETCHES))
    placed = keys.withColumn("_bucket", F.floor((F.col("_k") - ends.select("low").scalar()) / span))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(sizes, "_bucket", "_n")
    size = F.floor(F.col("all_rows") / parts)
    wanted = (size > F.col("before")) & (size <= F.col("before") + F.col("_n"))
    target = totals.filter(wanted).select("_bucket", (size - F.col("before")).alias("_nth"))
    inside = Window.partitionBy("_bucket").orderBy("_k")
    bound = (
        placed.join(F.broadcast(target), "_bucket")  # one row
        .withColumn("_at", F.row_number().over(inside))
        .filter(F.col("_at") == F.col("_nth"))
        .select("_k")
    )
    return df.filter(F.col(key) <= bound.scalar())


# --- exact splits ---------------------------------------------------------------------------------

TRAIN, TEST = "train", "test"


def split_cutoff(
    keys: DataFrame, key, fraction: float, seed: int, rounding: str = "floor"
) -> DataFrame:
    """One row, or none: the hash of the last test key.

    Counting by hash bucket finds the bucket that holds it; only that bucket is then sorted.
    """
    if rounding not in ("floor", "ceil"):
        raise ValueError("rounding is 'floor' or 'ceil'")
    hashed = keys.select(hash_order(key, seed).alias("_hash")).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(sizes, "_bucket", "_n")
    size = {"floor": F.floor, "ceil": F.ceil}[rounding](F.col("all_rows") * F.lit(fraction))
    wanted = (size > F.col("before")) & (size <= F.col("before") + F.col("_n"))
    target = totals.filter(wanted).select("_bucket", (size - F.col("before")).alias("_nth"))
    inside = Window.partitionBy("_bucket").orderBy("_hash")
    return (
        hashed.join(F.broadcast(target), "_bucket")  # one row
        .withColumn("_at", F.row_number().over(inside))
        .filter(F.col("_at") == F.col("_nth"))
        .select(F.col("_hash").alias("cutoff"))
    )


def _split_by(df: DataFrame, keys: DataFrame, key, fraction, seed, rounding) -> DataFrame:
    cutoff = split_cutoff(keys, key, fraction, seed, rounding)
    is_test = hash_order(key, seed) <= cutoff.scalar()
    return df.withColumn("split", F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def split_exact(
    df: DataFrame, key, fraction: float, seed: int, rounding: str = "floor"
) -> DataFrame:
    """Adds ``split``: the first ``fraction`` of the seeded order is the test part.

    The size is exact.  Rows are not moved: each compares its hash with one scalar.
    """
    return _split_by(df, df, key, fraction, seed, rounding)


def split_grouped(
    df: DataFrame, group, fraction: float, seed: int, rounding: str = "floor"
) -> DataFrame:
    """Like ``split_exact`` over the distinct groups; all rows of a group land on one side."""
    groups = df.select(*as_list(group)).distinct()
    return _split_by(df, groups, group, fraction, seed, rounding)
