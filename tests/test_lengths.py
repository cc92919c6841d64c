"""Length quantiles, exact and from sketches."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from promptloom.operators import lengths as L

SHARES = (0.07, 0.1, 0.5, 0.95, 1.0)


def exact(values, share):
    values = sorted(values)
    # in hundredths, so that a share's binary form plays no part
    at = values[max(math.ceil(round(share * 100) * len(values) / 100), 1) - 1]
    return at, sum(v > at for v in values)


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("abc"), None if rng.random() < 0.05 else int(rng.lognormvariate(5, 1.5))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 7, 100, 3000])
def test_exact_quantiles(spark, n):
    rows = [*made(n, n), (None, 4), (None, 9)]
    df = spark.createDataFrame(rows, "kind string, len int")
    got = {(r.kind, r.share): (r.length, r.longer) for r in L.length_quantiles(df, "kind", F.col("len"), SHARES).collect()}
    wanted = {}
    for kind in {k for k, v in rows if v is not None}:
        values = [v for k, v in rows if k == kind and v is not None]
        wanted |= {(kind, s): exact(values, s) for s in SHARES}
    assert got == wanted


def test_no_rows_and_wrong_shares(spark):
    df = spark.createDataFrame([("a", None)], "kind string, len int")
    assert L.length_quantiles(df, "kind", F.col("len")).collect() == []
    with pytest.raises(ValueError, match="share"):
        L.length_quantiles(df, "kind", F.col("len"), (0,))


def test_sketches_merge_within_their_bound(spark):
    """The rank of a sketch's answer is within 2 % of the share asked for, over sketches of 20 parts."""
    values = [int(random.Random(k).lognormvariate(6, 2)) for k in range(40_000)]
    df = spark.createDataFrame([(k % 20, v) for k, v in enumerate(values)], "part int, len int")
    parts = L.length_sketch(df, "part", F.col("len"))
    whole = L.merge_sketches(parts.withColumn("all", F.lit("x")), "all")
    assert whole.select(F.length("sketch")).first()[0] < 10_000
    for r in L.sketch_quantiles(whole, "all", (0.1, 0.5, 0.9, 0.99)).collect():
        below = sum(v < r.length for v in values) / len(values)
        upto = sum(v <= r.length for v in values) / len(values)
        assert below - 0.02 <= r.share <= upto + 0.02
