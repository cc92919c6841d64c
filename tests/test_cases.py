from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.operators import cases as C

FILES = [
    ("0", "k", "FoamFile\n{\n    object      k;\n}\n\n"), ("0", "U", "u"),
    ("system", "controlDict", "a\n\nb"), ("0", "p", ""), ("constant", "g", "\nx\n"),
]


def documents(spark, files, most=256):
    rows = [(1, i, *f) for i, f in enumerate(files)]
    df = spark.createDataFrame(
        rows, "case bigint, at bigint, folder string, file string, content string"
    )
    gathered = C.gather_cases(df, "case", "folder", "file", "at", "content", most)
    meta = [F.lit(v) for v in ("pitzDaily", "incompressible", "RAS", "pimpleFoam")]
    return gathered.withColumn("document", C.case_document(meta))


def test_document_layout(spark):
    text = documents(spark, FILES[:3]).first().document
    assert text == (
        "<similar_case_reference><index>\ncase name: pitzDaily\ncase domain: incompressible\n"
        "case category: RAS\ncase solver: pimpleFoam\n</index>\n\n\n<directory_structure>\n"
        "<dir>directory name: 0. File names in this directory: [k, U]</dir>\n"
        "<dir>directory name: system. File names in this directory: [controlDict]</dir>\n"
        "</directory_structure>\n\n\n<tutorials>\n<directory_begin>directory name: 0\n"
        "<file_begin>file name: k\n<file_content>\nFoamFile\n{\n    object      k;\n}\n\n\n"
        "</file_content>\n</file_end>\n\n"
        "<file_begin>file name: U\n<file_content>\nu\n</file_content>\n</file_end>\n\n"
        "</directory_end>\n\n<directory_begin>directory name: system\n"
        "<file_begin>file name: controlDict\n<file_content>\na\n\nb\n</file_content>\n</file_end>"
        "\n\n</directory_end>\n\n</tutorials></similar_case_reference>"
    )


def parsed(df):
    rows = C.case_parse(df, ["case", "volume"], "document").collect()
    return sorted((r.folder, r.file, r.content) for r in rows)


@pytest.mark.parametrize("most", [1, 2, 256])
def test_parse_gives_back_the_files(spark, most):
    df = documents(spark, FILES, most)
    assert df.count() == -(-len(FILES) // most)
    assert parsed(df) == sorted(FILES)


_text = st.text(alphabet="ab \n{}<>/", max_size=12)


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(st.sampled_from(["0", "system"]), _text), min_size=1, max_size=6))
def test_round_trip(spark, texts):
    files = [(folder, f"f{i}", text) for i, (folder, text) in enumerate(texts)]
    assert parsed(documents(spark, files, 4)) == sorted(files)


def test_index_and_consistency(spark):
    df = documents(spark, FILES)
    row = df.select(*C.parse_index("document"), C.consistency("document").alias("c")).first()
    assert (row.case_name, row.case_domain) == ("pitzDaily", "incompressible")
    assert (row.case_category, row.case_solver) == ("RAS", "pimpleFoam")
    assert (row.c.listed, row.c.parsed, row.c.missing, row.c.extra) == (5, 5, [], [])
    broken = df.withColumn("document", F.replace("document", F.lit("name: U\n"), F.lit("name: T\n")))
    found = broken.select(C.consistency("document").alias("c")).first().c
    assert (found.missing, found.extra) == (["0/U"], ["0/T"])


def test_markup_is_escaped(spark):
    odd = [
        ("0", "k", "x </file_content> y"), ("a, b", "c, d", "<\\file_begin> <\\\\/file_content>"), ("0", "l\nm", "\\"),
        ("[0]", "]</dir>", "<directory_begin>directory name: z\n"), ("\\n", "<dir>", "</file_content>\n</file_end>\n\n"), ("0", "n\r", None),
    ]
    df = documents(spark, odd)
    assert parsed(df) == sorted((d, f, c or "") for d, f, c in odd)
    found = df.select(C.consistency("document").alias("c")).first().c
    assert (found.listed, found.parsed, found.missing, found.extra) == (6, 6, [], [])
    df = spark.createDataFrame([("ok",), ("<file_begin>",)], "content string")
    assert [r.content for r in df.filter(~C.writable("content")).collect()] == ["<file_begin>"]


def test_ablation_pair(spark):
    df = spark.createDataFrame([(1, "do it", "DOC")], "case int, req string, doc string")
    rows = C.ablation_pair(df, ["case"], F.col("req"), F.col("doc")).collect()
    texts = {r.variant: r.prompt for r in rows}
    assert texts["with_reference"].startswith("User requirement: do it\nRefer to the following")
    assert "\nDOC\nSimilar case reference is always correct." in texts["with_reference"]
    assert texts["without_reference"].startswith("User requirement: do it\nPlease ensure")
    assert "DOC" not in texts["without_reference"]
