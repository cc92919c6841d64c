"""CSV and JSON files of records that span lines, read by many tasks."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptloom.sources import json_split, readers, spans, writers
from promptloom.sources.csv_split import read_csv_split
from promptloom.sources.json_split import read_columnar_split, read_records_split

DDL = "id long, a string, b string"
PARTS = ["a", "é", '"', "\n", ",", "\r\n", " ", "\\", "x" * 30, "[", "]", "{", "}", '":', "\t", "", '\\"', "]}"]


def made_rows(n, seed=3):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choices(PARTS, k=rng.randrange(0, 25)))
    return [(k, rng.choice([None, "", cell(), cell()]), cell()) for k in range(n)]


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def tasks(spark, path, ending):
    return spans.blocks(spark, path, ending).rdd.getNumPartitions()


@pytest.mark.parametrize("files", [1, 3])
def test_csv(spark, tmp_path, small_splits, files):
    rows = made_rows(2_000) + [(None, "long\n" * 20_000, 'ends "here"'), (None, None, None)]
    path = str(tmp_path / "csv")
    writers.write_csv(spark.createDataFrame(rows, DDL).coalesce(files), path)
    got = read_csv_split(spark, path, DDL)
    assert in_order(got) == in_order(readers.read_csv(spark, path, DDL)) and got.count() == len(rows)
    assert tasks(spark, path, "\n") > 2 * files


def test_csv_of_other_programs(spark, tmp_path):
    """Carriage returns, empty lines, a header over two lines, no line break at the end."""
    file = tmp_path / "one.csv"
    file.write_bytes(b'id,"the\nfirst",b\r\n1,"x\r\ny",\r\n\r\n2,"",z\r\n3,"say ""no""",last')
    assert in_order(read_csv_split(spark, str(file), DDL)) == [(1, "x\r\ny", None), (2, "", "z"), (3, 'say "no"', "last")]
    file.write_bytes(b"id,a,b\n")
    assert read_csv_split(spark, str(file), DDL).collect() == []
    file.write_bytes(b'id,a,b\n1,"open,x\n')
    with pytest.raises(ValueError, match="do not pair"):
        read_csv_split(spark, str(file), DDL)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_arrays(spark, tmp_path, small_splits, indent, ascii_only):
    rows = made_rows(1_500) + [(None, "," * 50_000, "]" * 50_000)]
    for part in range(2):
        records = [dict(zip(("id", "a", "b"), r, strict=True)) for r in rows[part::2]]
        (tmp_path / f"{part}.json").write_text(json.dumps(records, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ] \n")
    path = str(tmp_path)
    got = read_records_split(spark, path, DDL)
    assert in_order(got) == in_order(readers.read_records(spark, path, DDL)) and got.count() == len(rows)
    assert tasks(spark, path, ",") > 8


def test_arrays_nested(spark, tmp_path):
    records = [{"id": 1, "m": {"k": [1, 2, {"z": "]"}]}, "l": ["a,b", '"']}, {"id": 2, "m": None, "l": []}]
    (tmp_path / "a.json").write_text(json.dumps(records))
    schema = "id long, m struct<k: array<string>>, l array<string>"
    assert in_order(read_records_split(spark, str(tmp_path), schema).select("id", "l")) == [(1, ["a,b", '"']), (2, [])]
    assert read_records_split(spark, str(tmp_path), schema).filter("id = 1").first().m.k == ["1", "2", '{"z":"]"}']


def test_broken_arrays(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text('[{"id": 1}, {"id": oops}, {"id": 3}]')
    kept = read_records_split(spark, str(file), "id long", on_broken="keep").collect()
    assert sorted((r.id or 0, r[readers.BROKEN]) for r in kept) == [(0, '{"id": oops}'), (1, None), (3, None)]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_records_split(spark, str(file), "id long").collect()
    for text, reason in (('[{"id": 1}, {"id": 2}', "ends inside"), ('[{"id": "1}]', "ends inside"), ('{"id": 1}', "does not begin")):
        file.write_text(text)
        with pytest.raises(ValueError, match=reason):
            read_records_split(spark, str(file), "id long")


@pytest.mark.parametrize("indent", [None, 1])
def test_columns(spark, tmp_path, small_splits, indent):
    rows = made_rows(1_200)
    for part in range(2):
        columns = dict(zip(("b", "id", 'other "name": '), zip(*[(b, k, a) for k, a, b in rows[part::2]], strict=True), strict=True))
        (tmp_path / f"{part}.json").write_text(json.dumps(columns, indent=indent))
    (tmp_path / "2.json").write_text('{"id": [7, 8], "b": ["short"], "more": [] }')
    (tmp_path / "3.json").write_text('{"id": [], "b": []}')
    got = read_columnar_split(spark, str(tmp_path), 'id long, b string, `other "name": ` string, absent string')
    wanted = [(k, b, a, None) for k, a, b in rows] + [(7, "short", None, None), (8, None, None, None)]
    assert in_order(got) == sorted(wanted, key=lambda r: tuple((x is None, x) for x in r))
    assert tasks(spark, str(tmp_path), ",") > 4


def test_broken_columns(spark, tmp_path):
    file = tmp_path / "a.json"
    for text, reason in (('{"a": [1], "a": [2]}', "twice"), ('{"a": {"b": 1}}', "object where"), ('[{"a": 1}]', "does not begin")):
        file.write_text(text)
        with pytest.raises(Exception, match=reason):
            read_columnar_split(spark, str(file), "a long").collect()


def test_written_arrays(spark, tmp_path):
    rows = made_rows(200)
    for name, df in (("full", spark.createDataFrame(rows, DDL).repartition(3)), ("none", spark.createDataFrame([], DDL))):
        path = tmp_path / name
        writers.write_records(df, str(path))
        loaded = [tuple(r.values()) for file in path.glob("part-*") for r in json.loads(file.read_text(encoding="utf-8"))]
        assert sorted(loaded, key=lambda r: r[0]) == (rows if name == "full" else [])
        assert in_order(read_records_split(spark, str(path), DDL)) == in_order(df)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(), st.text(max_size=6), st.lists(st.text(max_size=3), max_size=3), st.dictionaries(st.text(max_size=3), st.text(max_size=3), max_size=2)), max_size=8), st.integers(1, 7), st.booleans())
def test_elements_of_any_cut(elements, n_blocks, ascii_only):
    """Whatever blocks the pieces between commas fall into, the elements are those of the array."""
    text = json.dumps(elements, ensure_ascii=ascii_only)
    pieces = text.split(",")
    size = -(-len(pieces) // n_blocks)
    starts = range(0, len(pieces), size)
    batch = lambda k: pa.record_batch([pa.array(["f"] * len(pieces[k : k + size])), pa.array([k] * len(pieces[k : k + size]), pa.int64()), pa.array(pieces[k : k + size])], names=["file", "block", "value"])
    effects = [tuple(r.values()) for k in starts for b in json_split._effects(iter([batch(k)])) for r in b.to_pylist()]

    def follow(state, e):
        return state[0] != e[0], state[1] + (e[2] if state[0] else e[1])

    before = spans.carried([(f, k, (t, o, i)) for f, k, t, o, i, _ in effects], follow, (False, 0))
    assert before["f", -1] == (False, 0)

    class States:
        value = before

    found = []
    for ends in (False, True):
        for k in starts:
            found += [r for b in json_split._elements(States, 1, ends)(iter([batch(k)])) for r in b.to_pylist()]
    found.sort(key=lambda r: (r["block"], r["place"]))
    joined, current = [], None
    for r in found:
        if r["kind"] == spans.WHOLE:
            joined.append(r["value"])
        elif r["kind"] == spans.OPEN:
            current = r["value"]
        else:
            current += r["value"]
            if r["kind"] == spans.CLOSE:
                joined.append(current)
    assert [json.loads(v) for v in joined if v.strip()] == elements
