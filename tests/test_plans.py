"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
# a user's function, a codec, token lookup, records that span lines
PYTHON_QUERIES = {
    "score_stub", "generate_and_compare", "encode_bytes", "encode", "encode_pair", "decode", "truncate_pad", "pad_only",
    "pad_longest", "collate", "mask_pad", "mask_assistant", "masked_accuracy_arrays", "training_set", "csv_split_scan", "json_array_scan", "json_columns_scan",
}
# hide their plan behind a checkpoint or write; what they return is only a scan
WRITERS = {
    "csv_roundtrip", "csv_text_scan", "json_roundtrip", "columnar_unzip", "split_dataset",
    "line_roundtrip", "rewrite_kept", "convert_format", "step_log_stream",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - WRITERS))
def test_plan(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = re.search(r"ArrowEvalPython|BatchEvalPython|MapIn(Pandas|Arrow)|FlatMap(Co)?Groups", text)
    assert bool(python) == (name in PYTHON_QUERIES)
    # nothing but counts and sums is ever sent to one task
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 4])
            assert "Aggregate" in below, below


def test_filter_is_pushed(spark):
    text = plan(entry_points.queries()["isolate_file"](spark, FOLDER))
    assert "EqualTo(role,system)" in text


@pytest.mark.parametrize(
    "name, columns",
    [("keep_columns", "doc_id:bigint,lang:string,source:string"), ("split_floor", "doc_id:bigint"),
     ("attach_similar", "doc_id:bigint,lang:string,source:string,n_chars:bigint"),
     ("path_vocabulary", "html:string")],
)
def test_only_needed_columns_are_read(spark, name, columns):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert columns in schemas
    assert not any("text:" in s for s in schemas)


@pytest.mark.parametrize(
    "name", ["path_parts", "drop_columns", "replace_map", "tag_extract", "missing_sections",
             "marker_split", "split_thinking", "json_map", "stringify"]
)
def test_row_operators_do_not_shuffle(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text
