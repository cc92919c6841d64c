from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptloom.functions.text import tokens
from promptloom.operators import vocabulary as V

TEXTS = {1: "b a b", 2: "", 3: "c a\tb <eos> d", 4: "z" * 300 + " a", 5: "  "}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, text string")


def expected_ids():
    """Text that reads like a special token has an id of its own."""
    counts = Counter(w for t in TEXTS.values() for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return {w: i + len(V.SPECIALS) for i, w in enumerate(order)}


def test_vocab(spark, docs):
    vocab = V.build_vocab(docs, tokens("text"))
    rows = vocab.collect()
    assert {r.token: r.id for r in rows if r.id >= len(V.SPECIALS)} == expected_ids()
    assert [r.token for r in sorted(rows)[: len(V.SPECIALS)]] == V.SPECIALS


@pytest.mark.parametrize("head", [V.HEAD, 4, 0])
def test_encode_and_back(spark, docs, monkeypatch, head):
    """The same ids whatever share of the vocabulary is broadcast."""
    monkeypatch.setattr(V, "HEAD", head)
    vocab = V.build_vocab(docs, tokens("text"))
    coded = V.encode(docs, "id", tokens("text"), vocab, tags=F.transform(
        tokens("text"), lambda t, i: i))
    ids = expected_ids()
    got = {r.id: (r.ids, r.tags) for r in coded.collect()}
    assert got == {
        k: ([ids[w] for w in t.split()], list(range(len(t.split())))) for k, t in TEXTS.items()
    }
    back = V.decode(coded, "id", "ids", vocab)
    assert {r.id: r.text for r in back.collect()} == {
        k: " ".join(t.split()) for k, t in TEXTS.items()
    }


def test_bounded_vocab_has_unknown_tokens(spark, docs):
    vocab = V.build_vocab(docs, tokens("text"), max_size=5)
    assert vocab.count() == 5
    got = {r.id: r.ids for r in V.encode(docs, "id", tokens("text"), vocab).collect()}
    known = {w: i for w, i in expected_ids().items() if i < 5}
    assert got[3] == [known.get(w, V.UNK) for w in TEXTS[3].split()]
    assert V.UNK in got[3]


def test_null_keys_are_an_error(spark, docs):
    vocab = V.build_vocab(docs, tokens("text"))
    bad = docs.union(spark.createDataFrame([(None, "a")], docs.schema))
    with pytest.raises(Exception, match="null key"):
        V.encode(bad, "id", tokens("text"), vocab).collect()


def test_carried_columns_and_null_token_arrays(spark, docs):
    vocab = V.build_vocab(docs, tokens("text"))
    rows = spark.createDataFrame([(1, None, "x"), (2, ["a", None], "y")], "id int, t array<string>, extra string")
    got = {r.id: (r.extra, r.ids) for r in V.encode(rows, "id", F.col("t"), vocab, carry=["extra"]).collect()}
    assert got == {1: ("x", []), 2: ("y", [expected_ids()["a"], V.UNK])}


@pytest.mark.parametrize("head", [V.HEAD, 0])
def test_ids_outside_the_vocabulary_read_as_unknown(spark, docs, monkeypatch, head):
    monkeypatch.setattr(V, "HEAD", head)
    vocab = V.build_vocab(docs, tokens("text"))
    a = expected_ids()["a"]
    rows = spark.createDataFrame([(1, [a, 999, a, None, V.EOS]), (2, []), (3, None)], "id int, ids array<int>")
    got = {r.id: r.text for r in V.decode(rows, "id", "ids", vocab).collect()}
    assert got == {1: "a <unk> a <unk>", 2: "", 3: ""}
    whole = {r.id: r.text for r in V.decode(rows, "id", "ids", vocab, skip_special=False).collect()}
    assert whole[1] == "a <unk> a <unk> <eos>"


def test_plug_in_codec(spark, docs):
    coded = docs.select("id", V.encode_with(V.utf8_bytes, F.col("text")).alias("ids")).collect()
    assert {r.id: r.ids for r in coded} == {k: list(t.encode()) for k, t in TEXTS.items()}


def test_workers_make_parts_of_bounded_size():
    """A batch of many long rows comes back in parts, with the same rows and what the head lacks."""
    rows = [[f"w{(k * 7 + j) % 50}" for j in range(k % 400)] for k in range(4000)]
    batch = pa.record_batch({"id": range(4000), "_in": pa.array(rows, pa.list_(pa.string()))})
    head = pa.array(range(3, 33), pa.int32()), pa.array([f"w{k}" for k in range(30)])
    made = list(V._numbered(iter([batch]), *head))
    assert len(made) > 2 and max(len(b.column("_ids").flatten()) for b in made) <= V.ENTRIES
    got = [(i, [t[-1 - x] if x < 0 else f"w{x - 3}" for x in ids]) for b in made for i, ids, t in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert got == list(enumerate(rows))
    numbers = pa.record_batch({"id": range(4000), "_in": pa.array([[int(w[1:]) + 3 for w in r] for r in rows], pa.list_(pa.int32()))})
    made = list(V._worded(iter([numbers]), *head, True))
    assert len(made) > 2 and max(len(b.column("_toks").flatten()) for b in made) <= V.ENTRIES
    got = [
        (i, [t or f"w{tail[k] - 3}" for t, k in zip(toks, at, strict=True)])
        for b in made for i, toks, at, tail in zip(*[c.to_pylist() for c in b.columns], strict=True)
    ]
    assert got == list(enumerate(rows))


def test_a_codec_makes_parts_of_bounded_size():
    texts = ["ab" * (k % 300) if k % 5 else None for k in range(3000)] + ["c" * (V.ENTRIES + 5), ""]
    made = list(V._coded(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)]), V.utf8_bytes()))
    assert len(made) > 3 and sorted(sum(0 if x is None else x.size for x in m) for m in made)[-2] <= V.ENTRIES
    assert [None if x is None else bytes(x.tolist()) for m in made for x in m] == [None if t is None else t.encode() for t in texts]
