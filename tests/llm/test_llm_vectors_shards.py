"""Vector search against brute force; shards by their law."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import neighbours, shards

FOLDER = "/root/testdata/sf0.01"


def exact(rows, queries, k):
    """All cosines; ties to the smaller id."""
    out = {}
    for q in queries:
        scored = [(-float(np.dot(v, rows[q]) / np.sqrt(np.dot(v, v) * np.dot(rows[q], rows[q]))), i) for i, v in rows.items() if i != q and v.size == rows[q].size]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_tables(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    queries = [i for i in rows if i % 50 == 0]
    found, wanted = answers(neighbours.nearest(table, F.col("id") % 50 == 0, 5)), exact(rows, queries, 5)
    assert all(len(found[q]) == 5 for q in queries)
    assert sum(len(set(found[q]) & set(wanted[q])) for q in queries) >= 0.9 * 5 * len(queries)


def test_blocks_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = {k: rng.standard_normal(8) for k in range(60)}
    for k in range(30, 45):
        rows[k] = rows[7].copy()  # one vector many times
    rows[200], rows[201] = np.array([1.0, 2.0]), np.array([2.0, 1.0])
    bad = [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0] * 7 + [None]), (304, [float("nan")] * 8), (305, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    data = [(k, v.tolist()) for k, v in rows.items()] + bad + [(7, rows[7].tolist())]
    table = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<double>, rank int, score string")
    found = answers(neighbours.nearest(table, F.col("id") % 10 == 0, 5, block=16, query_block=3))
    assert found == exact(rows, [k for k in rows if k % 10 == 0], 5)
    assert answers(neighbours.nearest(table.filter("vec_id >= 200"), F.col("id") % 50 == 0)) == {200: [201]}
    assert neighbours.nearest(table.limit(0), F.col("id") % 50 == 0).collect() == []


def test_scores_are_cosines(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, F.col("id") == 0, 5).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, pytest.approx(0.6)), (2, pytest.approx(-1.0))]


def check_law(rows, found, n_shards):
    sizes = {}
    for r in found:
        assert (r.law, r.grown_shard) == ("bytes", None)
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    wanted = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == wanted
    total, largest = sum(s for _, s, _ in wanted), max(s for _, s, _ in wanted)
    for shard in range(n_shards):
        held = sizes.get(shard, [])
        assert sorted(slot for slot, _ in held) == list(range(len(held)))
        assert abs(sum(s for _, s in held) - total / n_shards) <= 2 * largest


def test_shards_on_the_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = shards.shard(docs, 8).collect()
    check_law([tuple(r) for r in docs.select("doc_id", "text").collect()], found, 8)


@pytest.mark.parametrize("samples", [32, 1])
def test_shards_of_hot_rows(spark, monkeypatch, samples):
    monkeypatch.setattr(shards, "SAMPLES", samples)
    rows = [(k, "hot text") for k in range(300)] + [(5, "again") for _ in range(300)] + [(k, "t" * (k % 40)) for k in range(400)]
    rows += [(None, "no id"), (None, None), (9, None), (10, ""), (11, "long " * 300)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, shard int, key string").repartition(6)
    check_law(rows, shards.shard(docs, 8).collect(), 8)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in shards.shard(docs, 8).collect()) == [1, 2]
    assert shards.shard(docs.limit(0), 8).collect() == []
