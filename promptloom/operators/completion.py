"""Response markers in conversations that lie in many rows.

A marker is a sequence of ids, and may begin in one row and end in another.  So each row looks for it in its own ids
with the ``m - 1`` ids before it in front, which come from the rows before: ``m - 1`` of them at most.  Rows of a conversation
are cut into blocks by rank, and each block also gets that many rows of the one before, so no task holds a whole
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.masks import IGNORE
from promptloom.operators.order import keyed_rank, skew_join
from promptloom.session import cut

#: Rows of a conversation that are looked at by one task.
BLOCK = 1 << 12


def with_starts(rows: DataFrame, key: str, order: str, size: Column, out: str = "start", span: int = 256) -> DataFrame:
    """``rows`` with the sum of ``size`` over the rows of the same key before each, in stretches of ``span`` order values."""
    cut_up = rows.withColumns({"_key": F.struct(key), "_stretch": F.floor(F.col(order) / span), "_size": size.cast("bigint")})
    sums = cut_up.groupBy("_key", "_stretch").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_stretch", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_key", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_up.join(starts, ["_key", "_stretch"])
    return placed.withColumn(out, F.col("_first") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_key", "_stretch", "_size", "_first")


def _tail(ids: str, n: int) -> Column:
    """The last ``n`` entries, or all if there are fewer."""
    return F.slice(ids, F.greatest(F.size(ids) - n, F.lit(0)) + 1, F.lit(n))


def _with_before(rows: DataFrame, key: str, order: str, ids: str, n: int, block: int) -> DataFrame:
    """``_before``: the last ``n`` ids of the conversation before the row, fewer at its beginning."""
    if not n:
        return rows.withColumn("_before", F.array().cast("array<int>"))
    ranked = keyed_rank(rows, key, order, "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / block))
    narrow = ranked.select(F.struct(key).alias("_key"), "_pos", "_block", _tail(ids, n).alias("_ids"))
    # a row is among the n before every row of its own block, and of the next one if it is near its end
    copied = narrow.withColumn("_home", F.explode(F.sequence("_block", F.floor((F.col("_pos") + n - 1) / block))))
    frame = Window.partitionBy("_key", "_home").orderBy("_pos").rowsBetween(-n, -1)
    before = copied.withColumn("_all", F.flatten(F.collect_list("_ids").over(frame)))
    before = before.filter(F.col("_home") == F.col("_block")).select("_key", "_pos", _tail("_all", n).alias("_before"))
    keyed = ranked.withColumn("_key", F.struct(key))
    return keyed.join(before, ["_key", "_pos"]).drop("_key", "_pos", "_block")


def mark_places(rows: DataFrame, key: str, order: str, start: str, ids: str, marker: list[int], block: int = BLOCK) -> DataFrame:
    """``key, first_mark, last_mark``: where the marker begins in each conversation, null in one without it.

    ``order`` is an integer, unique inside a key, and ``start`` the number of ids before the row.
    """
    if not marker:
        raise ValueError("a marker has at least one id")
    filled = rows.filter(F.size(ids) > 0).select(key, order, F.col(start).alias("_start"), F.col(ids).cast("array<int>").alias("_own"))
    looked = _with_before(filled, key, order, "_own", len(marker) - 1, block).withColumn("_all", F.concat("_before", "_own"))
    first = F.col("_start") - F.size("_before")

    def fits(i: Column) -> Column:
        hit = F.get("_all", i) == marker[0]
        for k, wanted in enumerate(marker[1:], start=1):
            hit = hit & (F.get("_all", i + k) == wanted)
        return hit

    places = F.transform("_all", lambda x, i: F.when(fits(i), first + i))
    found = looked.groupBy(key).agg(F.min(F.array_min(places)).alias("first_mark"), F.max(F.array_max(places)).alias("last_mark"))
    return found


def completion_labels(
    rows: DataFrame, key: str, order: str, start: str, ids: str, marker: list[int], out: dict[str, str] | None = None, block: int = BLOCK
) -> DataFrame:
    """``rows`` with labels that skip everything up to and including the conversation's last, or first, marker.

    ``out`` names the columns to add and which marker each goes by; it is ``{"labels": "last"}`` if left out.  Without a marker
    all of the conversation is skipped.  ``rows`` are read for the markers and again for the labels, so they are kept first.
    """
    out = out or {"labels": "last"}
    if not set(out.values()) <= {"first", "last"}:
        raise ValueError("occurrence is 'first' or 'last'")
    rows = cut(rows)
    marks = mark_places(rows, key, order, start, ids, marker, block)
    froms = [(F.col(f"{o}_mark") + len(marker)).alias(f"_{o}") for o in ("first", "last")]
    # a conversation may hold a large share of all rows
    marked = skew_join(rows.withColumn("_key", F.struct(key)), marks.select(F.struct(key).alias("_key"), *froms), ["_key"], [order], "left")

    def labels(occurrence: str) -> Column:
        there = lambda i: F.coalesce(F.col(start) + i >= F.col(f"_{occurrence}"), F.lit(False))
        return F.transform(ids, lambda x, i: F.when(there(i), x).otherwise(IGNORE))

    return marked.withColumns({name: labels(o) for name, o in out.items()}).drop("_key", "_first", "_last")
