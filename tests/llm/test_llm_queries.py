"""The registered queries and the pipeline."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from promptloom.llm import decontaminate, minmax, pii, quality  # noqa: E402
from promptloom.llm.queries import CHECKS, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    2: ["query_id", "rank", "vec_id", "score"],
    3: ["doc_id", "n_shingles", "component_id", "kept"],
    4: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    5: ["doc_id", "paragraph_no", "family"],
    6: ["doc_id", "item_id", "first_word", "n_words", "similarity"],
    7: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    8: ["doc_id", "held_out", "score", "predicted"],
    9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    10: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    11: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    12: ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    13: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


def test_all_are_registered():
    names = {n: [q for q in QUERIES if q.startswith(f"op{n}_")] for n in COLUMNS}
    assert all(len(found) == 1 for found in names.values()) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry_points.queries()) and set(CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name != "pipeline":
        wanted = COLUMNS[int(name[2:].split("_")[0])]
        assert df.columns[: len(wanted)] == wanted
    rows = df.collect()
    assert rows
    if name in CHECKS:
        assert difference(df, connect(FOLDER), CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    """On the table that the SQL is judged on."""
    folder = "/root/testdata/sf0.01"
    assert difference(QUERIES[name](spark, folder), connect(folder), CHECKS[name]) is None


def test_leaks_sql(spark, tmp_path):
    """Reordered, cut and short passages, and equal windows one after the other."""
    word = lambda k: f"w{k}"
    item = [word(k) for k in range(50)]
    other = [word(1000 + k) for k in range(400)]
    docs = [
        (1, other[:60] + item[25:] + item[:25] + other[60:100]), (2, other[:20] + item[:22] + other[20:21] + item[22:] + other[30:50]),
        (3, other[:3] + item[5:] + other[3:30]), (4, item[:47]), (5, item[:30]), (6, ["same"] * 70), (7, item), (7, item), (8, []),
    ]
    items = [(1, item), (2, ["same"] * 50), (3, other[300:304]), (4, [])]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/all/{name}")
        (part,) = (tmp_path / "all" / name).glob("*.parquet")
        part.rename(tmp_path / f"{name}.parquet")
    name = "op6_benchmark_decontamination"
    found = QUERIES[name](spark, str(tmp_path))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 1)}
    assert difference(found, connect(str(tmp_path)), CHECKS[name]) is None


def test_stages_take_effect(spark):
    """Each stage, given what the one before it kept, does what its operator finds."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality"](spark, docs, FOLDER)
    assert ids(good) == ids(quality.score(docs, labels).filter("predicted = 1"))
    alone = stage["near_duplicates"](spark, good, FOLDER)
    assert ids(alone) == ids(minmax.near_duplicates(good, width=5).filter("kept"))
    clean = stage["decontamination"](spark, alone, FOLDER)
    leaks = {r.doc_id for r in decontaminate.contaminated(alone, benchmark).collect()}
    assert ids(clean) == [i for i in ids(alone) if i not in leaks]
    private = stage["personal_data"](spark, clean, FOLDER)
    assert ids(private) == ids(clean)
    assert not any(pii.base_spans(r.text) for r in private.collect())
    for df in (good, alone, clean, private):
        assert df.columns == docs.columns
    tokens = stage["tokens"](spark, private, FOLDER)
    assert ids(tokens) == ids(private) and tokens.filter(~F.col("round_trip")).isEmpty()
    assert ids(QUERIES["pipeline"](spark, FOLDER)) == ids(tokens)


def test_stages_take_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of no one", None, None, 1), (3, "word " * 5_000, "en", "s", 1), (3, "word " * 5_000, "en", "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert len(docs.collect()) <= len(rows)
