from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptloom.operators import batches as B
from promptloom.operators import order as O


def h(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_shuffle_rank(spark):
    got = {r.id: r.rank for r in O.shuffle_rank(spark.range(500), "id", 3).collect()}
    expected = sorted(range(500), key=lambda k: h(3, k))
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == expected
    assert sorted(got.values()) == list(range(1, 501))


def test_global_rank_with_a_value_that_fills_a_third(spark):
    df = spark.range(999).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("v")
    )
    got = O.global_rank(df.repartition(13), [F.desc("v"), F.asc("id")]).collect()
    rows = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r["rank"] for r in rows] == list(range(1, 1000))


@pytest.mark.parametrize(
    "n, floor_size, ceil_size", [(0, 0, 0), (1, 0, 1), (9, 1, 1), (10, 2, 1), (21, 4, 2)]
)
def test_split_sizes(spark, n, floor_size, ceil_size):
    df = spark.range(n)

    def tests(fraction, rounding):
        return {
            r.id for r in O.split_exact(df, "id", fraction, 5, rounding).collect()
            if r.split == "test"
        }

    order = sorted(range(n), key=lambda k: h(5, k))
    assert tests(0.2, "floor") == set(order[:floor_size])
    assert tests(0.05, "ceil") == set(order[:ceil_size])


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    reference = {r.id: r.split for r in O.split_exact(df, "id", 0.2, 1).collect()}
    assert Counter(reference.values()) == {"train": 800, "test": 200}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = O.split_exact(df.orderBy(F.desc("id")).repartition(17), "id", 0.2, 1)
        assert {r.id: r.split for r in again.collect()} == reference
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_split_grouped_keeps_a_hot_group_together(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("g")
    )
    sides = O.split_grouped(df, "g", 0.25, 9).groupBy("g").agg(F.collect_set("split").alias("s"))
    rows = sides.collect()
    assert all(len(r.s) == 1 for r in rows)
    assert sum(r.s == ["test"] for r in rows) == math.floor(40 * 0.25)


def test_skew_join_equals_join(spark):
    left = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 70).alias("k")
    )
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = O.skew_join(left, right, ["k"], ["id"], how).select("id", "k", "v").collect()
        expected = left.join(right, "k", how).select("id", "k", "v").collect()
        assert Counter(got) == Counter(expected)


@pytest.mark.parametrize("span, block", [(7, 5), (1000, 1000), (1, 30)])
def test_moving_average_in_blocks(spark, span, block):
    keys = [0, 1, None, 3]
    rows = [(i, 0 if i % 3 == 0 else keys[i % 4], float(i * i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "at bigint, k bigint, v double")
    got = O.moving_average(df, "k", "at", "v", 5, block=block, span=span).collect()
    seen: dict = {}
    expected = {}
    for at, k, v in rows:
        seen.setdefault(k, []).append(v)
        last = seen[k][-5:]
        expected[at] = sum(last) / len(last)
    assert len(got) == len(rows)
    assert all(abs(r.moving - expected[r["at"]]) < 1e-9 for r in got)


def test_keyed_rank(spark):
    rows = [(i * 3, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "at bigint, k bigint")
    got = O.keyed_rank(df, "k", "at", "r", span=10).collect()
    for k in (0, 1):
        assert [r.r for r in sorted(got, key=lambda r: r["at"]) if r.k == k] == list(range(1, 26))


def test_rank_within_ties(spark):
    rows = [
        ("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 1, 2.0), (None, 1, 4.0), (None, 2, 3.0),
        ("b", 2, None),
    ]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    got = O.rank_within(df, "g", -F.col("v"), "id", "place").collect()
    assert {(r.g, r.id): r.place for r in got} == {
        ("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("b", 1): 1, (None, 1): 1,
        (None, 2): 2, ("b", 2): 2,
    }


def test_prefix_share(spark):
    df = spark.range(28).select(F.col("id") * 5, F.lit("x").alias("t")).toDF("id", "t")
    assert sorted(r.id for r in O.prefix_share(df, 6, "id").collect()) == [0, 5, 10, 15]
    assert O.prefix_share(spark.range(5), 6, "id").count() == 0


@pytest.mark.parametrize("n, batch", [(100, 2), (7, 2), (1, 4)])
def test_length_groups(spark, n, batch):
    df = spark.range(n).select("id", (F.col("id") * 7 % 13).alias("len"))
    got = B.length_groups(df, "id", "len", batch, 7, most=5).collect()
    size = max(min(n // (4 * batch), 5), 1) * batch
    order = sorted(range(n), key=lambda k: h(7, k))
    expected = {}
    for mega in range(0, n, size):
        group = sorted(order[mega:mega + size], key=lambda k: (-(k * 7 % 13), order.index(k)))
        expected.update({k: (mega // size, pos + 1) for pos, k in enumerate(group)})
    assert {r.id: (r.megabatch, r.pos) for r in got} == expected


def test_collate_pads_to_the_longest(spark):
    rows = [(1, 0, [1]), (2, 0, [1, 2, 3]), (3, 1, [9])]
    df = spark.createDataFrame(rows, "id int, batch int, ids array<int>")
    out = B.collate(B.pad_batch(df, "batch", "ids", 0), "batch", "id", ["padded"]).collect()
    assert {r.batch: r.padded for r in out} == {0: [[1, 0, 0], [1, 2, 3]], 1: [[9]]}


@pytest.mark.parametrize("width", [4, 10, 25])
def test_moving_average_wider_than_a_block(spark, width):
    df = spark.range(40).select(F.col("id").alias("at"), F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["at"]: r.moving for r in O.moving_average(df, "k", "at", "v", width, block=4).collect()}
    assert got == {i: sum(range(max(0, i - width + 1), i + 1)) / min(width, i + 1) for i in range(40)}


def test_composite_and_null_keys_split_exactly(spark):
    rows = [("a", "b:c"), ("a:b", "c"), (None, "a"), ("a", None), (None, None), ("", "a"), ("a", ""), ("1", "2"), ("12", ""), ("", "12")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(O.hash_order(["x", "y"], 1).alias("h")).distinct().count() == 10
    assert O.split_exact(df, ["x", "y"], 0.2, 1).filter("split = 'test'").count() == 2


def test_prefix_share_of_uneven_keys(spark):
    keys = [*range(0, 50), *range(10**12, 10**12 + 50), 5 * 10**17]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    assert sorted(r.id for r in O.prefix_share(df, 2, "id").collect()) == keys[:50]
