"""WARC archives, whitening and fill-in-the-middle against plain versions."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import struct

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.llm import archives, infill, whitening

ENDING = archives.ENDING
PAGES = "page_id long, url string, html string"


def plain_pages(rows, least=0):
    """What the contract says of pages ``(id, url, html)``; rows alike in all are numbered."""
    of = {}
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    for row in sorted(rows, key=order):
        of.setdefault((row[2] or "").encode(), []).append(row)
    out = []
    for payload, group in of.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, row in enumerate(group):
            first = k == 0 or len(payload) < least
            out.append((row[0], len(payload), digest, "response" if first else "revisit", None if first else group[0][0]))
    return sorted(out, key=str)


def result(records):
    found = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted((tuple(r) for r in found), key=str)


ROWS = [
    (3, "http://a/ b\n", "<p>one</p>"), (1, "http://b/é", "<p>one</p>"), (2, None, None), (5, "", ""), (None, "http://c/", "<p>one</p>"),
    (7, "u", "x" * 300_000), (8, "u", "tail\r\n\r\n" + ENDING.decode() * 3), (9, "u", "tail\r\n\r\n" + ENDING.decode() * 3),
    (11, "w", "same row"), (11, "w", "same row"), (11, "w", "same row"), (11, "v", "same row"), (None, None, "nobody's"), (None, None, "nobody's"),
]


def folder_of(tmp_path):
    return f"file://{tmp_path}/archive"


@pytest.mark.parametrize("least", [0, 9])
@pytest.mark.parametrize("few", [0, 100])
def test_round_trip(spark, tmp_path, monkeypatch, least, few):
    monkeypatch.setattr(archives, "FEW", few)
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], PAGES + ", digest string").repartition(3)
    archives.write_archives(pages, folder_of(tmp_path), least=least)
    records = archives.read_archives(spark, folder_of(tmp_path))
    assert result(records) == plain_pages(ROWS, least)
    full = archives.with_payloads(records).collect()
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in full) == sorted(
        (i is None, i or 0, (t or "").encode()) for i, _, t in ROWS
    )
    assert {r.url for r in full} == {None, "http://a/%20b%0A", "http://b/é", "http://c/", "u", "w", "v"}


def test_files_stand_alone(spark, tmp_path):
    """A plain reader of one file: the dictionary at its head, then a frame a record, empty frames passed over."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html>page {k % 50} " + "words of it " * 30) for k in range(400)], PAGES)
    archives.write_archives(pages.repartition(2), folder_of(tmp_path))
    seen, names, framed, alone = 0, set(), 0, 0
    files = list(tmp_path.glob("archive/*.warc"))
    for file in files:
        data = file.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == archives.DICTIONARY_MAGIC
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(
            io.BytesIO(data[8 + size :]), read_across_frames=True
        )
        text = reader.read()
        heads = re.findall(rb"WARC/1\.1\r\nWARC-Type: (\w+)\r\nWARC-Record-ID: (\S+)\r\n", text)
        assert heads[0][0] == b"warcinfo"
        seen += sum(kind != b"warcinfo" for kind, _ in heads)
        names |= {name for _, name in heads}
        framed += len(data) - 8 - size
        alone += sum(len(zstandard.compress(r, archives.LEVEL)) for r in re.split(rb"(?=WARC/1\.1\r\n)", text) if r)
    assert len(files) >= 2 and seen == 400 and len(names) == 400 + len(files)
    # the frames take less than half of what the same records take without the dictionary
    assert framed < alone / 2


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "u", "".join(map(chr, rng.choices(range(32, 0x2FFF), k=400)))) for k in range(500)]
    archives.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder_of(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = archives.read_archives(spark, folder_of(tmp_path))
        assert records.select(F.spark_partition_id()).distinct().count() > 5
        assert result(records) == plain_pages(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(spark, tmp_path):
    archives.write_archives(spark.createDataFrame([], PAGES), folder_of(tmp_path))
    assert archives.read_archives(spark, folder_of(tmp_path)).collect() == []


def test_broken_payload_is_an_error():
    data = archives.record(1, "u", "A" * 32, 3, b"abc", None, None)
    with pytest.raises(ValueError, match="not the one"):
        archives.parse(data)
    with pytest.raises(ValueError, match="as long"):
        archives.parse(data[:-6])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([ENDING, ENDING[:4], ENDING[4:], b"P*M", b"\x18\0", bytes(range(256))]), max_size=60), st.randoms())
def test_frames_never_hold_their_ending(parts, rng):
    data = b"".join(p + rng.randbytes(rng.choice([0, 0, 1, 40])) for p in parts)
    frame = archives.compress(data, zstandard.ZstdCompressor(level=archives.LEVEL))
    assert ENDING not in frame
    assert zstandard.ZstdDecompressor().decompress(frame) == data


# whitening


def plain_whitening(vectors, components):
    """Rows ``(position, component, n, deviation, whitened, explained)`` by exact sums and an eigensolver."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    centred = np.array([[float(n * row[k] - s[k]) / n for k in range(d)] for row in x])
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    out = {}
    for at, row in enumerate(x):
        deviation = sum((n * row[k] - s[k]) ** 2 for k in range(d))
        for c in range(min(components, int((values > 1e-9 * values[0]).sum()))):
            out[at, c + 1] = (n, deviation, centred[at] @ directions[:, c] / np.sqrt(values[c]), values[c] / np.trace(v))
    return out


def same_whitening(rows, vectors, components=8):
    wanted = plain_whitening(vectors, components)
    assert {(r.vec_id, r.component) for r in rows} == set(wanted) and len(rows) == len(wanted)
    for c in range(1, components + 1):
        own = {r.vec_id: r for r in rows if r.component == c}
        if own:
            sign = np.sign(sum(own[k].whitened * wanted[k, c][2] for k in own))
            for k, r in own.items():
                n, deviation, whitened, explained = wanted[k, c]
                assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
                assert abs(r.whitened * sign - whitened) < 1e-7 * (1 + abs(whitened)) and abs(r.explained / explained - 1) < 1e-9
    assert all(r.identity_error < 1e-9 for r in rows) and len({r.identity_error for r in rows}) <= 1


@pytest.mark.parametrize(("n", "d", "rank"), [(60, 5, 5), (40, 12, 12), (50, 9, 3), (3, 6, 6), (200, 1, 1)])
def test_whitening(spark, n, d, rank):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, rank)) * np.geomspace(3, 0.5, rank)) @ rng.standard_normal((rank, d)) + 5
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df.repartition(4)).collect()
    if rank >= min(n - 1, d):
        same_whitening(rows, vectors)
    else:  # the grid adds noise of full rank
        assert {r.component for r in rows} == set(range(1, min(8, d) + 1)) and all(r.identity_error < 1e-4 for r in rows)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [3.0, -1.0], [0.5, 0.25]]
    rows = [(k, v, "x") for k, v in enumerate(good)]
    bad = [(10, None, "x"), (11, [1.0, None], "x"), (12, [nan, 1.0], "x"), (13, [inf, 1.0], "x"), (14, [], "x"), (15, [1.0, 2.0, 3.0], "x")]
    kinds = "vec_id long, embedding array<double>, component string"
    same_whitening(whitening.whiten(spark.createDataFrame(rows + bad, kinds)).collect(), good)
    assert whitening.whiten(spark.createDataFrame(bad[:5], kinds)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], kinds)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], "x") for k in range(5)], kinds)).collect() == []
    nobody = whitening.whiten(spark.createDataFrame([(None, v, "x") for _, v, _ in rows], kinds)).collect()
    assert len(nobody) == 8 and {r.vec_id for r in nobody} == {None}


def test_whitening_of_large_entries(spark):
    """Sums of squares beyond a double's exact numbers, and beyond a long."""
    vectors = [[3.0e8, -2.0e8], [-1.0e8, 5.0e7], [7.7e8, 1.0], [2.0, 3.0e8]]
    kinds = "vec_id long, embedding array<double>"
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), kinds)).collect()
    wanted = plain_whitening(vectors, 8)
    assert all(int(r.deviation_exact) == wanted[r.vec_id, r.component][1] for r in rows)
    assert all((r.deviation is None) == (int(r.deviation_exact) >= 1 << 63) for r in rows) and any(r.deviation is None for r in rows)
    assert all(r.identity_error < 1e-9 for r in rows)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [1.0, 1.0])], kinds)).collect()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 1000))
def test_eigenvectors(d, rank, seed):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((d, rank))
    m[:, rank // 2 :] = np.round(m[:, rank // 2 :])  # ties and zeros
    v = m @ m.T
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, atol=1e-9 * max(1, np.abs(v).max()))
    values, directions = whitening.one_sided_jacobi(factor)
    assert np.all(np.diff(values) <= 0) and np.allclose(directions.T @ directions, np.eye(values.size), atol=1e-9)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: values.size], atol=1e-9 * max(1, np.abs(v).max()))


# fill-in-the-middle


def plain_infill(id_, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


PARTS = st.lists(st.sampled_from(["a", "Zx", " ", "é", "😀", "\n", "1", "<", "<P", "S>", "<M>", "abcdefgh", "\0"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 500), PARTS.map("".join), st.sampled_from([1, 2, 3, 8, 4096]))
def test_infill(id_, text, block):
    made = infill.transform(id_, text, block=block)
    assert (made.n, made.form, made.output, made.prefix_chars, made.middle_chars) == plain_infill(id_, text)
    assert infill.restore(made.output, made.form) == text


def test_infill_of_rows(spark):
    rng = random.Random(1)
    long_texts = ["a" * 100_000, "".join(rng.choices("ab cé\n", k=60_000)), "😀" * 20_000]
    rows = [(None, "no id here"), (1, None), (2, ""), (3, "twice"), (3, "twice"), *enumerate(long_texts, 4)]
    rows += [(k, f"text number {k}, with words") for k in range(20, 120)]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, form string")
    found = sorted((tuple(r) for r in infill.examples(docs).collect()), key=str)
    wanted = []
    for id_, text in rows:
        n, form, output, prefix, middle = plain_infill(id_, text)
        wanted.append((id_, n, form, prefix, middle, output))
    assert found == sorted(wanted, key=str)
    assert {form for _, _, form, *_ in found} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted((tuple(r) for r in infill.digests(docs).select("doc_id", "output_sha256", "restored_sha256").collect()), key=str)
    assert digests == sorted(((i, digest(plain_infill(i, t)[2]), digest(t or "")) for i, t in rows), key=str)
    assert infill.examples(docs.limit(0)).collect() == []


def test_restore_refuses_another_form():
    with pytest.raises(ValueError, match="form"):
        infill.restore("<P>a<S>b<M>c", "spm")
