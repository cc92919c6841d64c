"""Token counts and BPE against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from promptloom.llm import bpe_trie, byte_bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts() -> list[str]:
    rng = random.Random(3)
    letters = "aaabbb  \n\t\r'sdllreve012٣é漢字😀..!!--  ßʰªⅷ½"
    words = [SPECIAL, " ", "  ", "\n", "abc", "the", " of", "'ll", "!!", " ", "é", "x" * 40]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["a" * 3000, "ab" * 1500, " " * 2000, SPECIAL * 3, f" {SPECIAL} x", f"hi  {SPECIAL}", f"!!{SPECIAL}", ""]


def test_encoding_equals_the_library(library):
    coder, given = bpe_trie.Trie(byte_bpe.parse(byte_bpe.content(PATH))), texts()
    wanted = [library.encode(t, add_special_tokens=False).ids for t in given]
    packed = list(coder.encode_all(given))
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == wanted
    assert [coder.decode(p) for p in packed] == [library.decode(w, skip_special_tokens=False) for w in wanted]


def test_control_characters_are_no_white_space(library):
    rng = random.Random(5)
    letters = "ab1.'  \n\n\t\x0b\x0c\x1c\x1d\x1e\x1f\x00\x7f\x85\xa0é"
    given = ["a\n\n\x1fb", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3_000))]
    given += [t + "Ω" for t in given[:500]]
    coder = bpe_trie.Trie(byte_bpe.parse(byte_bpe.content(PATH)))
    wanted = [library.encode(t, add_special_tokens=False).ids for t in given]
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode_all(given)] == wanted


def test_every_token_is_its_own_encoding():
    coder = bpe_trie.Trie(byte_bpe.parse(byte_bpe.content(PATH)))
    ids = coder.vocabulary.ids
    assert all(coder.alone(t) == np.asarray([n], "<u4").tobytes() for t, n in ids.items())


def test_only_tokens_that_end_at_a_letter_are_tried(library):
    class Counted(dict):
        lookups = 0

        def get(self, *key):
            Counted.lookups += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.lookups += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.lookups += 1
            return super().__contains__(key)

    coder = bpe_trie.Trie(byte_bpe.parse(byte_bpe.content(PATH)))
    words = {a + b + c for a in (" inter", "un", " é", "x" * 300) for b in ("", "nation", "token") for c in ("ing", "als", "ization")}
    coder.encode_words(words)
    coder.ids = Counted(coder.ids)
    found = coder.encode_words(words)
    prefixes = {w.encode()[:n] for w in words for n in range(1, len(w.encode()) + 1)}
    assert Counted.lookups <= len(prefixes)
    assert all(np.frombuffer(found[w], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids for w in words)


def test_windows_do_not_change_the_encoding(monkeypatch):
    content = byte_bpe.content(PATH)
    given = [t * 20 for t in texts()[:200]] + ["y" * 500, None]
    whole = list(bpe_trie.Trie(byte_bpe.parse(content)).encode_all(given))
    monkeypatch.setattr(bpe_trie, "WINDOW", 50)
    assert list(bpe_trie.Trie(byte_bpe.parse(content), most_words=10, most_fits=30).encode_all(given)) == whole


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 40), (32_768, 1_024)])
def test_splicing_equals_the_library(library, chunk, overlap):
    counter = token_counts.Counter(byte_bpe.parse(byte_bpe.content(PATH)), chunk, overlap)
    for text in texts():
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


ROWS = [(1, None, 7), (2, "", 7), (None, "some words", None), (3, "same same", 1), (3, "same same", 1), (4, "word " * 40_000, 0)]


def test_count_rows(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens int")
    found = sorted(map(tuple, token_counts.count_tokens(docs, PATH, limit=2).collect()), key=repr)
    wanted = []
    for id_, text, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((id_, len((text or "").encode()), n, n > 2))
    assert found == sorted(wanted, key=repr)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_round_trip_rows(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, packed int")
    found = sorted(map(tuple, bpe_trie.round_trip(docs, PATH).collect()), key=repr)
    wanted = []
    for id_, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((id_, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)
    assert bpe_trie.round_trip(docs.limit(0), PATH).collect() == []


def test_decode_gives_the_text_back(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, packed int")
    decoded = bpe_trie.decode(bpe_trie.encode(docs, PATH), PATH)
    assert sorted(map(tuple, decoded.collect()), key=repr) == sorted(((i, t or "") for i, t, _ in ROWS), key=repr)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        byte_bpe.parse(byte_bpe.content(public_tokenizers.path("word_bpe_49k.json")))
