"""Markers over row borders, against whole conversations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from promptloom.functions.masks import IGNORE, mask_completion
from promptloom.operators import completion

DDL = "conv string, turn int, ids array<int>"


def conversations(seed):
    rng = random.Random(seed)
    out = []
    for conv in ["a", "b", "c", "d", None]:
        for turn in sorted(rng.sample(range(400), rng.randrange(1, 40))):
            out.append((conv, turn, [rng.randrange(3) for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 7]))]))
    return out


def plain(rows, marker, occurrence):
    whole = {}
    for conv, turn, ids in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        whole.setdefault(conv, []).append((turn, ids))
    out = {}
    for conv, parts in whole.items():
        ids = [x for _, part in parts for x in part]
        hits = [k for k in range(len(ids) - len(marker) + 1) if ids[k : k + len(marker)] == marker]
        begin = (hits[0 if occurrence == "first" else -1] + len(marker)) if hits else len(ids)
        at = 0
        for turn, part in parts:
            out[conv, turn] = [x if at + k >= begin else IGNORE for k, x in enumerate(part)]
            at += len(part)
    return out


@pytest.mark.parametrize("occurrence", ["first", "last"])
@pytest.mark.parametrize("marker", [[1], [2, 1], [0, 1, 2], [1, 1, 1, 1, 0], [7]])
def test_labels(spark, marker, occurrence):
    rows = conversations(len(marker))
    df = completion.with_starts(spark.createDataFrame(rows, DDL).repartition(5), "conv", "turn", F.size("ids"), span=16)
    made = completion.completion_labels(df, "conv", "turn", "start", "ids", marker, {"labels": occurrence}, block=3)
    assert made.columns == ["conv", "turn", "ids", "start", "labels"]
    assert {(r.conv, r.turn): r.labels for r in made.collect()} == plain(rows, marker, occurrence)


def test_as_in_a_single_row(spark):
    """The same as the rule for a row that is a whole conversation."""
    rng = random.Random(5)
    rows = [(str(k), 0, [rng.randrange(3) for _ in range(30)]) for k in range(40)]
    df = spark.createDataFrame(rows, DDL).withColumn("start", F.lit(0))
    for occurrence in ("first", "last"):
        made = completion.completion_labels(df, "conv", "turn", "start", "ids", [1, 2, 0], {"labels": occurrence})
        assert made.filter(F.col("labels") != mask_completion("ids", [1, 2, 0], occurrence)).count() == 0


def test_wrong_arguments(spark):
    df = spark.createDataFrame([("a", 0, [1])], DDL).withColumn("start", F.lit(0))
    with pytest.raises(ValueError, match="occurrence"):
        completion.completion_labels(df, "conv", "turn", "start", "ids", [1], {"labels": "any"})
    with pytest.raises(ValueError, match="at least one"):
        completion.completion_labels(df, "conv", "turn", "start", "ids", [])
