from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from promptloom.operators.pairs import pair_files, unpaired_files
from promptloom.functions.text import marker_split
from promptloom.sources import readers, writers

DDL = "id int, text string"
ROWS = [
    (1, 'line1\nline2, "quoted" \\ back'), (2, "  blanks  "), (3, None), (4, "é—ü"), (5, ""),
    (6, "NONE"), (7, "\r\n"), (8, '"'), (9, "a\\"),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, DDL)


def test_csv(spark, df, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(df, path)
    assert sorted(map(tuple, readers.read_csv(spark, path, DDL).collect())) == ROWS
    text = readers.read_csv_text(spark, path, ["id", "text"])
    assert sorted(map(tuple, text.collect())) == [(str(i), t) for i, t in ROWS]


def test_jsonl(spark, df, tmp_path):
    path = str(tmp_path / "jsonl")
    writers.write_jsonl(df, path)
    assert sorted(map(tuple, readers.read_jsonl(spark, path, DDL).collect())) == ROWS


@pytest.mark.parametrize("rows", [2, 100])
def test_columnar(spark, df, tmp_path, rows):
    path = str(tmp_path / "columnar")
    chunks = writers.to_columnar(df, [F.desc("id")], rows)
    assert max(len(r.id) for r in chunks.collect()) <= rows
    whole = [i for r in sorted(chunks.collect(), key=lambda r: r.chunk) for i in r.id]
    assert whole == [r[0] for r in reversed(ROWS)]
    writers.write_columnar(df, path, [F.desc("id")], rows)
    assert sorted(map(tuple, readers.read_columnar(spark, path, DDL).collect())) == ROWS


def test_foreign_json(spark, tmp_path):
    records = tmp_path / "records.json"
    records.write_text(json.dumps([{"id": i, "text": t} for i, t in ROWS], indent=4))
    got = readers.read_records(spark, str(records), DDL)
    assert sorted(map(tuple, got.collect())) == ROWS
    columnar = tmp_path / "columnar.json"
    columnar.write_text(
        json.dumps({"id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS]}, indent=4)
    )
    got = readers.read_columnar(spark, str(columnar), DDL, multi_line=True)
    assert sorted(map(tuple, got.collect())) == ROWS


def test_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.createDataFrame([('{"a": 1}',), ("{}",)], "line string")
    writers.write_lines(df, "line", path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"a": 1}', "{}"]


def test_convert(spark, df, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    writers.write_jsonl(df, source)
    writers.convert(
        lambda: readers.read_jsonl(spark, source, DDL), writers.write_csv, target
    )
    assert sorted(map(tuple, readers.read_csv(spark, target, DDL).collect())) == ROWS


def test_rewrite_in_place(spark, df, tmp_path):
    path = str(tmp_path / "data")
    writers.write_jsonl(df, path)
    former = writers.rewrite(
        spark, path, lambda p: readers.read_jsonl(spark, p, DDL),
        lambda d: d.filter("text is not null"), writers.write_jsonl,
    )
    assert readers.read_jsonl(spark, path, DDL).count() == len(ROWS) - 1
    assert readers.read_jsonl(spark, former, DDL).count() == len(ROWS)


def test_dataset_splits(spark, df, tmp_path):
    path = str(tmp_path / "set")
    split = F.when(F.col("id") > 3, "train").otherwise("test")
    writers.write_dataset(df.withColumn("split", split), path)
    assert readers.read_dataset(spark, path, DDL).count() == len(ROWS)
    named = readers.read_declared(
        spark, {"path": path, "dataset": "train", "eval_dataset": "test"}, DDL
    )
    assert named["dataset"].count() == len(ROWS) - 3 and named["eval_dataset"].count() == 3
    plan = named["eval_dataset"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    capped = readers.read_declared(spark, {"path": path, "dataset": "train", "max_samples": 2}, DDL)
    assert list(capped) == ["dataset"]
    assert sorted(r.id for r in capped["dataset"].collect()) == [4, 5]


def test_probe_files(spark, tmp_path):
    for folder, name in [("0", "k"), ("0", "U"), ("system", "controlDict"), ("0 a+b", "U#1 x")]:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"{name}.txt").write_text(
            f"code system prompt:\nS {name}\ncode user prompt:\nU {name}\n"
        )
    (tmp_path / "0" / "k").write_text("answer k\n")
    (tmp_path / "0 a+b" / "U#1 x").write_text("answer U\n")
    prompts = readers.read_text_tree(spark, str(tmp_path), extension=".txt")
    answers = readers.read_text_tree(spark, str(tmp_path), extension="")
    assert readers.read_text_tree(spark, str(tmp_path)).count() == 6
    keys = ["folder", "name"]
    split = prompts.select(*keys, marker_split("value").alias("s")).select(*keys, "s.*")
    paired = pair_files(split, answers.withColumnRenamed("value", "file_content"), keys)
    assert sorted(tuple(r) for r in paired.collect()) == [
        ("0", "k", "S k\n", "U k\n", "answer k\n"), ("0 a+b", "U#1 x", "S U#1 x\n", "U U#1 x\n", "answer U\n"),
    ]
    left = unpaired_files(split, answers, keys)
    assert {(r.folder, r.name) for r in left.collect()} == {("0", "U"), ("system", "controlDict")}


def test_broken_json(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"id": 1}\n{"id": broken\n{"id": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.read_jsonl(spark, str(tmp_path / "lines"), "id int").collect()
    kept = readers.read_jsonl(spark, str(tmp_path / "lines"), "id int", on_broken="keep").collect()
    assert sorted((r.id or 0, r[readers.BROKEN] or "") for r in kept) == [(0, '{"id": broken'), (1, ""), (3, "")]
