from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptloom.functions.text import missing_paths
from promptloom.operators import frames, pairs, pivot

RAW = [
    ("d1", '{"0/U":"u1","0/p":"p1"}', ["0/U", "0/p"], "run1"),
    ("d2", '{"0/U":"line1\\nline2"}', ["0/U"], "run2"),
    ("d3", '{"x/y":"z"}', ["x/y"], "run3"),
    ("d4", "{}", [], "run4"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        RAW, "description string, foamfiles string, file_tree array<string>, allrun string"
    )


def test_raw_to_wide(spark, raw):
    known = raw.filter("description <> 'd3'")
    files = pivot.raw_to_files(known, ["description"], "file_tree", "foamfiles")
    wide = pivot.pivot_files(files, ["description"], "path", "content", pivot.FILE_PATHS)
    rows = {r.description: r for r in wide.collect()}
    assert rows["d1"]["0/U"] == "u1" and rows["d1"]["0/p"] == "p1"
    assert sum(rows["d1"][n] == "NONE" for n in pivot.FILE_PATHS) == 16
    assert rows["d2"]["0/U"] == "line1\nline2"
    back = pivot.unpivot_files(wide, ["description"], pivot.FILE_PATHS)
    assert sorted(map(tuple, back.collect())) == [
        ("d1", "0/U", "u1"), ("d1", "0/p", "p1"), ("d2", "0/U", "line1\nline2"),
    ]


def test_unknown_path(spark, raw):
    files = pivot.raw_to_files(raw, ["description"], "file_tree", "foamfiles")
    args = (["description"], "path", "content", pivot.FILE_PATHS)
    with pytest.raises(Exception, match="unknown file name: x/y"):
        pivot.pivot_files(files, *args).collect()
    dropped = pivot.pivot_files(files, *args, on_unknown="drop")
    assert {r.description for r in dropped.collect()} == {"d1", "d2"}


def test_missing_paths(spark, raw):
    missing = raw.select("description", missing_paths("file_tree", pivot.FILE_PATHS).alias("m"))
    sizes = {r.description: len(r.m) for r in missing.collect()}
    assert sizes == {"d1": 16, "d2": 17, "d3": 18, "d4": 18}


def test_path_vocabulary(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],)], "p array<string>")
    got = {tuple(r) for r in pivot.path_vocabulary(df, F.col("p")).collect()}
    assert got == {("a", 2, 3), ("b", 1, 1)}


def test_files_map_volumes(spark):
    rows = [(1, i, f"t{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, text string")
    out = pivot.files_map(df, "k", "at", F.concat(F.lit("f"), F.col("at")), "text", most=2)
    assert {r.volume: r.files for r in out.collect()} == {
        0: {"f0": "t0", "f1": "t1"}, 1: {"f2": "t2", "f3": "t3"}, 2: {"f4": "t4"},
    }


CHAT = [
    ("S", "U", "A", "controlDict"), (None, "U", "A", "blockMeshDict"), ("NA", "U", "NONE", "p"),
    ("S", "U", "", "k"), ("S", "U", "none of it", "U"),
]


def test_drop_null(spark):
    df = spark.createDataFrame(
        CHAT, "system_prompt string, user_prompt string, file_content string, file_name string"
    )
    assert {r.file_name for r in frames.drop_null(df).collect()} == {"controlDict", "U"}
    kept = frames.drop_null(df, ["file_content"])
    assert {r.file_name for r in kept.collect()} == {"controlDict", "blockMeshDict", "p", "U"}
    kept = frames.drop_null(df, na_tokens=[])
    assert {r.file_name for r in kept.collect()} == {"controlDict", "p", "k", "U"}


def test_strict_columns(spark):
    df = spark.range(1).select("id", F.lit(1).alias("a"))
    assert frames.drop_strict(df, ["a"]).columns == ["id"]
    for call in (frames.keep, frames.drop_strict):
        with pytest.raises(ValueError, match="nope"):
            call(df, ["a", "nope"])


def test_harmonise(spark):
    df = spark.createDataFrame([("s", "u", "c")], "system_prompt string, usr_prompt string, code_content string")
    expected = ["system_prompt", "user_prompt", "file_content"]
    assert frames.harmonise(df, expected=expected).columns == expected
    with pytest.raises(ValueError, match="case_name"):
        frames.harmonise(df, expected=["case_name"])


def test_stringify_and_profile(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "n int, s string")
    assert [tuple(r) for r in frames.stringify(df).collect()] == [("1", "ab"), ("None", "None")]
    rows = {r.column_name: r for r in frames.profile(df).collect()}
    assert (rows["s"].n_rows, rows["s"].n_nulls, rows["s"].avg_length) == (2, 1, 2.0)
    empty = frames.profile(df.limit(0)).collect()
    assert [r.n_rows for r in empty] == [0, 0]


def test_zip_stops_at_the_shorter(spark):
    a = spark.createDataFrame([(i,) for i in (5, 1, 9)], "a int")
    b = spark.createDataFrame([("y",), ("x",)], "b string")
    out = pairs.zip_by_position(a, b, [F.asc("a")], [F.asc("b")])
    assert {tuple(r) for r in out.collect()} == {(1, 1, "x"), (2, 5, "y")}


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Whether small shuffle partitions are put together, or groups are spread over several tasks."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield
    spark.conf.set(setting, before)


def test_attach_similar_against_all_pairs(spark, coalesced):
    rows = [(i, "g" if i % 3 else "h", (i * 37) % 23) for i in range(80)] + [(80, "alone", 5)]
    df = spark.createDataFrame(rows, "id int, g string, size bigint")
    reqs, cases = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {r.id: (r.gap, r.case_id) for r in pairs.attach_similar(
        reqs, cases, ["g"], "size", "id").collect()}
    expected = {
        i: min(((abs(s - s2), i2) for i2, g2, s2 in rows if i2 % 2 and g2 == g), default=(None, None))
        for i, g, s in rows if i % 2 == 0
    }
    assert got == expected


def test_leakage(spark):
    rows = [(1, "train", "x"), (2, "test", "x"), (3, "test", "y"), (4, "test", "x")]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    assert {r.id for r in pairs.leakage(df, "id", "text").collect()} == {2, 4}


def test_nan_is_dropped(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id int, v double")
    assert [r.id for r in frames.drop_null(df, ["v"]).collect()] == [1]


def test_missing_content_is_an_error(spark):
    raw = spark.createDataFrame([(1, ["a"], '{"b": "x"}'), (2, ["c"], "{broken"), (3, ["d"], '{"d": "y"}')], "id int, p array<string>, f string")
    for bad in (1, 2):
        with pytest.raises(Exception, match="no content for file"):
            pivot.raw_to_files(raw.filter(F.col("id") == bad), ["id"], "p", "f").collect()
    lenient = pivot.raw_to_files(raw, ["id"], "p", "f", on_missing="null").collect()
    assert {tuple(r) for r in lenient} == {(1, "a", None), (2, "c", None), (3, "d", "y")}
    assert {tuple(r) for r in pivot.broken_files(raw, ["id"], "p", "f").collect()} == {(1, "a"), (2, "c")}
