from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.streaming import steplog

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()), T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def write(spark, folder, name, rows):
    """One file, named so that files arrive in order."""
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["ts", "kind", "value"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(folder / name, index=False)


def run(spark, folder, **options):
    stream = steplog.read_log_stream(spark, str(folder), "*.parquet", SCHEMA, files_per_batch=1)
    out = steplog.step_log_stream(stream, "ts", "kind", "value", **options)
    return {(r.window_start, r.kind): (r.n, r.mean_value) for r in out.collect()}


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rows = [(at(i // 10, (i * 7) % 60), "ab"[i % 2], float(i)) for i in range(60)]
    for i in range(0, 60, 12):
        write(spark, tmp_path, f"part-{i:02d}.parquet", rows[i:i + 12])
    batch = steplog.step_log_windows(
        spark.read.schema(SCHEMA).parquet(str(tmp_path)), "ts", "kind", "value"
    )
    expected = {(r.window_start, r.kind): (r.n, r.mean_value) for r in batch.collect()}
    assert run(spark, tmp_path) == expected


def test_late_row_is_dropped(spark, tmp_path):
    import os

    write(spark, tmp_path, "a.parquet", [(at(0), "x", 1.0), (at(5), "x", 3.0)])
    write(spark, tmp_path, "b.parquet", [(at(6), "x", 5.0)])
    write(spark, tmp_path, "c.parquet", [(at(0, 30), "x", 9.0), (at(5, 59), "x", 7.0)])
    for i, name in enumerate(["a", "b", "c"]):
        os.utime(tmp_path / f"{name}.parquet", (1700000000 + i, 1700000000 + i))
    got = run(spark, tmp_path)
    assert got == {
        ("2024-01-01 00:00:00", "x"): (1, 1.0), ("2024-01-01 05:00:00", "x"): (2, 5.0),
        ("2024-01-01 06:00:00", "x"): (1, 5.0),
    }


def test_row_operators_run_on_a_stream(spark, tmp_path):
    from promptloom.functions.templates import chatml, messages2
    from promptloom.session import scratch_path

    source = tmp_path / "in"
    spark.createDataFrame([("q", "a")], "p string, r string").write.parquet(str(source))
    stream = spark.readStream.schema("p string, r string").parquet(str(source))
    target = scratch_path(spark, "rendered")
    query = (
        stream.select(chatml(messages2("p", "r")).alias("text")).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", target + "-progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    text = spark.read.parquet(target).select(F.col("text")).first().text
    assert text.endswith("<|im_start|>assistant\na<|im_end|>\n")


def test_paths_arrive_once(spark, tmp_path):
    """Each path with the batch that brought it first; a restart knows what came before."""
    from promptloom.streaming import arrivals

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    seen = {}
    for rows in ([["a", "b", "a"], ["b", None]], [["a", "c"], None], [["a", "b", "c"]], [["d"], []]):
        spark.createDataFrame([(r,) for r in rows], "paths array<string>").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("paths array<string>").parquet(source)
        out = arrivals.new_paths_stream(stream, F.col("paths"), target)
        found = [(r.path, r.arrival) for r in out.collect()]
        assert len(found) == len(dict(found))
        for path in {p for r in rows for p in r or [] if p}:
            seen.setdefault(path, len(seen) and max(seen.values()))
        assert set(dict(found)) == set(seen)
    order = dict(found)
    assert order["a"] == order["b"] < order["c"] < order["d"]


def test_replayed_steps_count_once(spark, tmp_path):
    """The numbers of the clean log, whatever is logged again, and whichever run meets it."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    steps = [(at(k // 6, (k % 6) * 10), "ab"[k % 2], float(k)) for k in range(40)]
    for number, part in enumerate((steps[:15], steps[12:25], steps[24:40], steps[36:40])):
        write(spark, source, f"part-{number}.parquet", part)
        got = run(spark, source, target=target, step=["ts", "kind"])
    clean = {}
    for ts, kind, value in steps:
        clean.setdefault((f"2024-01-01 {ts.hour:02d}:00:00", kind), []).append(value)
    assert got == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in clean.items()}


def test_files_stay_few(spark, tmp_path):
    """Twenty runs leave one merged table; what a run reads does not grow."""
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for number in range(20):
        write(spark, source, f"part-{number:02d}.parquet", [(at(number, 5), "a", 1.0), (at(number, 50), "a", 3.0)])
        got = run(spark, source, target=str(target))
        assert len(got) == number + 1
        assert len(list(target.glob("merged/batch=*"))) == 1 and not list(target.glob("data/batch=*"))
    assert set(got.values()) == {(2, 2.0)}


def test_a_broken_merge_is_made_up_for(spark, tmp_path):
    """A table without its mark is no table; batches that were merged but not deleted count once."""
    import shutil

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(spark, source, "part-0.parquet", [(at(0), "a", 1.0)])
    run(spark, source, target=str(target))
    (table,) = target.glob("merged/batch=*")
    shutil.copytree(table, target / "data" / table.name)  # not deleted
    (target / "merged" / "batch=99").mkdir()  # half written
    write(spark, source, "part-1.parquet", [(at(1), "a", 5.0)])
    assert run(spark, source, target=str(target)) == {("2024-01-01 00:00:00", "a"): (1, 1.0), ("2024-01-01 01:00:00", "a"): (1, 5.0)}
