"""Repeated strings and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import minmax, suffixes
from promptloom.llm import components as components_module
from promptloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def brute_repeats(rows):
    """By every 100-byte string, in order of ids."""
    out, seen = {}, set()
    for id_, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[id_] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def run_repeats(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, key string").repartition(4)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()}


def mixed_rows():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    parts = [some(n) for n in (60, 90, 99, 100, 101, 130, 180, 300, 900)]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(rng.randint(0, 6)):
            text += rng.choice([some(rng.randint(0, 80)), rng.choice(parts), rng.choice(parts)[rng.randint(0, 20) :], "a" * rng.randint(0, 260), "ab" * 90])
        rows.append((k, text))
    return rows + [(500 + k, rows[k][1]) for k in range(20)] + [(900, None), (901, ""), (None, parts[-1]), (3, rows[3][1])]


@pytest.mark.parametrize("many", [2_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    rows = mixed_rows()
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_repeats_of_long_texts(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(430_000))
    rows = [(0, base), (1, "x" * 1000), (2, base[190_000:260_000] + "zz" + base[100:410_000]), (3, "q" + base)]
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_repeats_on_the_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert run_repeats(spark, rows) == brute_repeats(rows)
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


def test_a_string_of_very_many_kinds(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(110))
    rows = [(k, f"{k * 7919:012d}{passage}{k * 104729:012d}") for k in range(21_000)]
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_more_bytes_than_powers_are_hashed():
    hashes = suffixes.Hashes(0x9E3779B97F4A7C15, 8)
    raw = np.arange(300).astype(np.uint8)
    prefix = hashes.prefix(raw)
    assert hashes.of(prefix, np.array([0]), np.array([40])) == hashes.of(prefix, np.array([256]), np.array([296]))


@pytest.mark.parametrize("bits", [11, 13])
def test_full_maps_lose_no_repeats(spark, monkeypatch, bits):
    monkeypatch.setattr(suffixes, "MANY", 3)
    monkeypatch.setattr(suffixes, "LEAST_BITS", 8)
    monkeypatch.setattr(suffixes, "MOST_BITS", bits)
    rows = mixed_rows()
    assert run_repeats(spark, rows) == brute_repeats(rows)


def test_wrong_hashes_are_found_out(monkeypatch):
    """Hashes that always agree leave the order to the bytes."""
    raw = np.frombuffer(b"".join(bytes([c]) * 3 + b"-" * 120 for c in b"cabcab"), np.uint8)
    suffix = suffixes.Suffixes(raw)
    for step in suffix.hashes:
        suffix.hashes[step] = np.zeros_like(suffix.hashes[step])
    places = np.arange(6) * 123
    group = np.zeros(6, np.int64)
    ordered = suffix.sort(places, group)
    same = suffix.verified(ordered, group)
    assert [chr(raw[p]) for p in ordered] == list("aabbcc")
    assert same.tolist() == [False, True, False, True, False, True]


# ---------------------------------------------------------------- near-duplicates


def shingle_set(text, width=4):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    smallest = {}
    for k, (id_, _) in enumerate(rows):
        if id_ is not None:
            smallest[find(k)] = min(id_, smallest.get(find(k), id_))
    return sorted(((id_, len(sets[k]), smallest.get(find(k))) for k, (id_, _) in enumerate(rows)), key=repr)


def near_rows():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3 % 997, " ".join(text).upper() if k % 3 else "\t".join(text)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "nobody else says this"), rows[1], (5003, "one"), (5004, "ONE")]


@pytest.mark.parametrize("block", [2_048, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "BUCKET_BLOCK", block)
    monkeypatch.setattr(minmax, "CLUSTER_BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, node string, signature binary")
    found = minmax.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.component_id is not None)


def test_near_duplicates_on_the_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = minmax.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows)
    assert minmax.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, __id int")
    docs = docs.withColumnRenamed("__id", "text_key")
    kept = minmax.deduplicate(docs).collect()
    assert docs.columns == list(kept[0].asDict())
    wanted = {c for i, n, c in brute_components(rows) if n and c is not None} | {i for i, t in rows if not shingle_set(t)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(wanted)
    assert [r.text for r in kept if r.doc_id is None] == ["nobody else says this"]


def test_components(spark):
    pairs = [(1, 2), (3, 2), (3, 9), (10, 11), (5, 5), (7, 6), (6, 7), *((20 + k, 21 + k) for k in range(30))]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 6: 6, 7: 6, **{20 + k: 20 for k in range(31)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def tasks_of(spark, run):
    """The result of ``run``, and how many tasks the driver had to keep track of for it."""
    group = f"tasks-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return out, sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info is not None)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    rounds = []
    large = components_module._large
    monkeypatch.setattr(components_module, "_large", lambda edges: rounds.append(1) or large(edges))
    stars = [(10 * k + j, 10 * k) for k in range(20) for j in range(1, 9)]
    found = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted(stars + [(10 * k, 10 * k) for k in range(20)])
    assert not rounds
    assert components(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")).filter("root = 1").count() == 3 and rounds


def test_rounds_of_components_cost_few_tasks(spark):
    """With many partitions nearly all tasks of a round read empty parts, and the driver has to keep all of them."""
    pairs = [(100 * k + j + 1, 100 * k + j) for k in range(9) for j in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, n_tasks = tasks_of(spark, lambda: components(spark.createDataFrame(pairs, "a long, b long")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.root for r in found} == {100 * k + j: 100 * k for k in range(9) for j in range(31)}
    assert 0 < n_tasks < 64 * 40


def test_linked_groups_are_stars(spark, monkeypatch):
    """What a cell finds linked needs no round of its own, however the links run inside it."""
    words = [f"w{k}" for k in range(400)]
    drift = [" ".join(words[3 * k : 3 * k + 100]) for k in range(20)]  # each is linked with its neighbours only
    rounds = []
    large = components_module._large
    monkeypatch.setattr(components_module, "_large", lambda edges: rounds.append(1) or large(edges))
    links = minmax._link(4, 80)(iter([pa.record_batch({"cell": [7] * 20, "node": [b"%02d" % (k * 7 % 20) for k in range(20)], "text": drift})]))
    edges = [tuple(r.values()) for batch in links for r in batch.to_pylist()]
    assert sorted(edges) == [(b"%02d" % k, b"00") for k in range(1, 20)]
    found = components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert {bytes(r.root) for r in found} == {b"00"} and len(found) == 20 and not rounds
