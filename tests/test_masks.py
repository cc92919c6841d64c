from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.functions import masks as M


def calc(spark, make, **columns):
    schema = ", ".join(f"{c} array<int>" for c in columns)
    df = spark.createDataFrame([tuple(columns.values())], schema)
    return df.select(make(*[F.col(c) for c in columns]).alias("out")).first().out


def test_fit_and_mask(spark):
    ids = [5, 6, 0]
    assert calc(spark, lambda x: M.fit(x, 5, 0), ids=ids) == [5, 6, 0, 0, 0]
    assert calc(spark, lambda x: M.attention(x, 5), ids=ids) == [1, 1, 1, 0, 0]
    by_token = calc(spark, lambda x: M.mask_pad(M.fit(x, 5, 0), 0), ids=ids)
    assert by_token == [5, 6, -100, -100, -100]
    by_mask = calc(
        spark, lambda x: M.mask_pad(M.fit(x, 5, 0), 0, "attention", M.attention(x, 5)), ids=ids
    )
    assert by_mask == [5, 6, 0, -100, -100]


def test_truncate(spark):
    ids = [1, 2, 3, 4]
    assert calc(spark, lambda x: M.fit(x, 3, 0), ids=ids) == [1, 2, 3]
    assert calc(spark, lambda x: M.fit(x, 3, 0, truncate=False), ids=ids) == ids
    assert calc(spark, lambda x: M.attention(x, 3, truncate=False), ids=ids) == [1, 1, 1, 1]
    assert calc(spark, lambda x: M.fit(x, 2, 0), ids=[]) == [0, 0]


@pytest.mark.parametrize(
    "ids, occurrence, expected",
    [
        ([5, 9, 6, 7], "last", [-100, -100, 6, 7]),
        ([5, 9, 6, 9], "last", [-100, -100, -100, -100]),
        ([5, 9, 6, 9], "first", [-100, -100, 6, 9]),
        ([5, 6], "last", [-100, -100]),
        ([], "last", []),
        ([9, 1], "first", [-100, 1]),
    ],
)
def test_mask_completion(spark, ids, occurrence, expected):
    assert calc(spark, lambda x: M.mask_completion(x, [9], occurrence), ids=ids) == expected


def test_mask_completion_long_marker(spark):
    found = calc(spark, lambda x: M.mask_completion(x, [8, 9]), ids=[8, 1, 8, 9, 5, 9])
    assert found == [-100, -100, -100, -100, 5, 9]


def test_mask_flagged(spark):
    labels = calc(spark, M.mask_flagged, ids=[4, 5, 6], flags=[0, 1, 0])
    assert labels == [-100, 5, -100]


def test_strip_prefix(spark):
    assert calc(spark, M.strip_prefix, out=[1, 2, 3], prompt=[1, 2]) == [3]
    assert calc(spark, M.strip_prefix, out=[1, 2], prompt=[1, 2]) == []


def test_token_counts(spark):
    pred, labels = [5, 8, 7], [5, 6, -100]
    assert tuple(calc(spark, M.token_counts, p=pred, l=labels)) == (1, 2)
    shifted = calc(spark, lambda p, l: M.token_counts(p, l, 1), p=[6, 1, 1], l=[5, 6, -100])
    assert tuple(shifted) == (1, 1)
    assert tuple(calc(spark, M.token_counts, p=[1], l=[-100])) == (0, 0)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.lists(st.integers(0, 4), max_size=12), min_size=1, max_size=6))
def test_labels_are_ids_or_ignored(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>")
    out = df.select(
        M.fit("ids", 8, 0).alias("f"),
        M.mask_pad(M.fit("ids", 8, 0), 0).alias("t"),
        M.mask_completion("ids", [3]).alias("c"), "ids",
    ).collect()
    for row in out:
        assert len(row.f) == 8
        assert all(t in (-100, i) for t, i in zip(row.t, row.f, strict=True))
        last = max((i for i, x in enumerate(row.ids) if x == 3), default=len(row.ids))
        assert row.c == [x if i > last else -100 for i, x in enumerate(row.ids)]
