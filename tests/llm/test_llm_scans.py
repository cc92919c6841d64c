"""Decontamination, licences, personal data and quality against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm import decontaminate, licences, pii, quality

FOLDER = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- decontamination


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def grams_of(words, width):
    return Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute_leaks(docs, items):
    """Every window of an item's length against the item."""
    out = {}
    for doc, text in docs:
        words = words_of(text)
        for item, item_text in items:
            wanted = words_of(item_text)
            if not wanted or len(wanted) > len(words):
                continue
            width = min(5, len(wanted))
            b = grams_of(wanted, width)
            best = 0
            for k in range(len(words) - len(wanted) + 1):
                a = grams_of(words[k : k + len(wanted)], width)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[doc, item] = best
    return out


def leak_rows():
    rng = random.Random(2)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([12, 30, 30, 45, 60])))) for k in range(25)]
    items += [(100, "only three words"), (101, None), (102, ""), (103, " ".join(["again"] * 30)), (0, items[0][1])]
    docs = []
    for k in range(80):
        words = some(rng.randint(0, 60))
        if k % 2:
            part = words_of(items[rng.randrange(25)][1])
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            words[3:3] = part
        docs.append((k, " \n".join(words).title() if k % 3 else "  ".join(words)))
    docs += [(200, None), (201, ""), (202, "x Only THREE words y"), (203, " ".join(["again"] * 50)), (None, items[3][1]), docs[1]]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_rows()
    table = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, item_id int, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(table, bench).collect()}
    wanted = brute_leaks(docs, items)
    assert found == pytest.approx(wanted)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns
    bad = {doc for doc, _ in wanted}
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in docs if i not in bad)


def test_leaks_in_any_window(spark):
    """Passages reordered, cut and inserted into; a document shorter than the item is a window of its own."""
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    items = [(k, some(50)) for k in range(6)]
    docs = []
    for k, item in items:
        docs.append((10 * k, some(60) + item[25:] + item[:25] + some(40)))
        docs.append((10 * k + 1, some(20) + item[:22] + some(1) + item[22:] + some(20)))
        docs.append((10 * k + 2, some(3) + item[5:] + some(30)))
        docs.append((10 * k + 3, some(9) + item[30:] + item[:30]))
    whole = brute_leaks([(i, " ".join(d)) for i, d in docs], [(i, " ".join(t)) for i, t in items])
    assert sum(doc % 10 == 0 for doc, _ in whole) == 6
    short = [(100, items[0][1][:47]), (None, items[0][1][2:]), (102, items[0][1][:30])]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in [*docs, *short]], "doc_id long, text string")
    found = decontaminate.contaminated(table, bench).collect()
    wanted = {**whole, (100, 0): 43 / 46, (None, 0): 44 / 46}
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(wanted)
    assert {r.doc_id: (r.first_word, r.n_words) for r in found if r.doc_id in (0, 100, None)} == {0: (60, 50), 100: (0, 47), None: (0, 48)}


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1, 0, 6, 1.0)]
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 1


def test_blocks_cover_the_print():
    covered = [b for low, bits in decontaminate._SPANS for b in range(low, low + bits)]
    assert covered == list(range(decontaminate.BITS))
    assert len(decontaminate._SPANS) == decontaminate.RADIUS + 1


# ---------------------------------------------------------------- licences


@pytest.fixture(scope="module")
def model():
    return licences.fit()


def plain_window(model, words):
    """The families of one window: (family, probability, similarity)."""
    place = {p: k for k, p in enumerate(model.pairs)}
    left = {p for p in zip(words, words[1:], strict=False) if p in place or any(p in t for _, t in model.templates)}
    out = []
    for _ in range(licences.FAMILIES):
        if not left:
            break
        scores = model.bias + sum((model.weights[place[p]] for p in sorted(left) if p in place), np.zeros(len(model.families)))
        family = model.families[int(scores.argmax())]
        chance = 1 / (1 + np.exp((scores[-1] - scores.max()) / model.temperature))
        if family == licences.UNKNOWN or chance < licences.PROBABLE:
            break
        own = [t for f, t in model.templates if f == family]
        stated = [t for t in own if all(p in left for p in t if any(c.isdigit() for c in " ".join(p)))]
        near = max((len(t & left) / len(t) for t in stated), default=0)
        if near >= licences.SIMILAR:
            out.append((family, round(float(chance), 6), round(near, 6)))
        left -= set().union(*own)
    return out


def plain_notices(model, text):
    """(paragraph, family) to (probability, similarity, first word), the most similar window's."""
    found = {}
    for k, paragraph in enumerate(re.split("\n(?:[^A-Za-z0-9\n]*\n)+", text or "")):
        words, half = licences._words(paragraph), licences.WINDOW // 2
        for at in range(0, len(words), half):
            for family, chance, near in plain_window(model, words[at : at + licences.WINDOW]):
                best = found.get((k, family))
                if best is None or near > best[1]:
                    found[k, family] = (chance, near, at)
    return found


def families(model, text):
    return sorted({f for _, f in plain_notices(model, text)})


def test_labelled_table_is_learned(model):
    assert all(families(model, t) == [f] for f, t in licences.examples() if f != licences.UNKNOWN)
    assert all(families(model, t) == [] for f, t in licences.examples() if f == licences.UNKNOWN)
    assert families(model, "nothing known at all") == []


#: Headers as they stand in files: wrapped, in comment marks, with a choice, with a version set apart.
HEADERS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": ["MIT"],
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *": ["BSD"],
    "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that": ["ISC"],
    "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0": ["Apache-2.0"],
    "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": ["GPL-3.0"],
    "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or": ["GPL-2.0"],
    "under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License": ["LGPL"],
    "under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the License": ["AGPL-3.0"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": ["MPL-2.0"],
    "This is free and unencumbered software released into\nthe public domain.": ["Unlicense"],
    "licensed under the MIT License or the Apache License, Version 2.0, at your option": ["Apache-2.0", "MIT"],
    "This text is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License": ["CC-BY-SA"],
    "The terms of the GNU General Public License apply": [],
}


def test_headers(model):
    assert {t: families(model, t) for t in HEADERS} == {t: sorted(f) for t, f in HEADERS.items()}


def test_frames_left_out_of_the_fit():
    """Precision and recall on wordings that the labelled table does not have."""
    model = licences.fit()
    frames = ["Copyright 2020. Use of this code is governed by the {} found in the root folder.", "SPDX tag for this module reads {} as of today.", "We publish all data under {} unless stated otherwise."]
    cases = [(f, frame.format(name)) for f, names in licences.NAMES.items() for name in names for frame in frames]
    right = sum(families(model, t) == [f] for f, t in cases)
    extra = sum(len(set(families(model, t)) - {f}) for f, t in cases)
    assert right / len(cases) >= 0.95 and extra / len(cases) <= 0.03


def test_notices_equal_the_plain_version(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = [(9001, None), (9002, ""), (None, "Released under the MIT License."), (9003, "x\n\nLicensed under the Apache License, Version 2.0.\n" * 2)]
    extra += [(9100 + k, f"{'word ' * (k * 13)}\n{t}\n\n --- \n{'more ' * 100}{t}") for k, t in enumerate(HEADERS)]
    docs = docs.union(spark.createDataFrame([*extra, extra[3]], docs.schema))
    wanted = {(doc, k, f, *rest) for doc, text in docs.collect() for (k, f), rest in plain_notices(model, text).items()}
    found = licences.notices(docs.selectExpr("*", "1 AS paragraph_no", "'a' AS family"), model).collect()
    rows = [(r.doc_id, r.paragraph_no, r.family, round(r.probability, 6), round(r.similarity, 6), r.first_word) for r in found]
    assert len(rows) == len(wanted) > 30 and set(rows) == wanted
    assert licences.notices(docs.limit(0), model).collect() == []


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The patterns as they are stated."""
    count = lambda m: len(re.sub("[^0-9]", "", m[0]))
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= count(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= count(m) <= 15]


@pytest.fixture(scope="module")
def field():
    return pii.fit()


@pytest.mark.parametrize("letters", ["ab1.@-_ é", "012. -+()", "a@b.c_", "4 -1", "0123456789.", "+(1) 5-"])
def test_patterns_are_the_stated_ones(letters):
    rng = random.Random(letters)
    for _ in range(2_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_an_address_may_begin_with_many_zeros():
    zeros = "0" * 5_000
    assert pii.base_spans(f"x {zeros}.0.0.0") == [("ip", 2, 5_008)]
    assert pii.base_spans(f"x {zeros}255.0.0.{zeros}7")[0] == ("ip", 2, 10_011)
    assert not any(kind == "ip" for kind, _, _ in pii.base_spans(f"x {zeros}256.0.0.1"))


def test_patterns_are_linear():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@" * 300_000, "a@" * 150_000, "+" * 300_000, "1 " * 150_000):
        pii.base_spans(text)


def test_field_learns_its_table(field):
    lines = pii.examples()
    found = pii.found_spans(field, [t for t, _ in lines], [[] for _ in lines])
    assert [sorted(f) for f in found] == [sorted(s) for _, s in lines]


def test_field_on_other_lines(field):
    held = ["please phone (651) 555-8500 soon", "write to maria dot lopez at example dot com now"]
    clean = ["on 2021-05-06 at 10:30 we saw 12 cats", "my number 4844508665317339 x", "the at dot the dot com", "one at a time", ""]
    assert [[text[a:b] for _, a, b in s] for text, s in zip(held, pii.found_spans(field, held, [[], []]), strict=True)] == [
        ["(651) 555-8500"], ["maria dot lopez at example dot com"],
    ]
    assert pii.found_spans(field, clean, [[] for _ in clean]) == [[] for _ in clean]


def test_viterbi_finds_the_best_path(field):
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    sequences = [rng.standard_normal((n, k)) for n in (1, 2, 5, 4)]
    for sequence, labels in zip(sequences, pii.viterbi(field, sequences), strict=True):
        score = lambda path, s=sequence: field.begin[path[0]] + sum(s[t, p] for t, p in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:]))
        paths = np.stack(np.meshgrid(*[range(k)] * len(sequence), indexing="ij"), -1).reshape(-1, len(sequence))
        assert score(list(labels)) == pytest.approx(max(score(list(p)) for p in paths))


def test_long_stretches_do_not_change_the_spans(field, monkeypatch):
    text = "word " * 300 + "7 " * 700 + "call 212-555-0199 now " * 60 + "\n" + "x" * 900 + " mail maria dot lopez at example dot com"
    whole = pii.found_spans(field, [text], [[]])
    monkeypatch.setattr(pii, "STRETCH", 1_000)
    assert len(whole[0]) >= 60 and sorted(pii.found_spans(field, [text], [[]])[0]) == sorted(whole[0])


PEOPLE = [
    (1, None), (2, ""), (None, "a.b@c.de and 10.0.0.255"), (3, "card 4111-1111-1111-1111, +1 (551) 555-0826"), (3, "card 4111-1111-1111-1111, +1 (551) 555-0826"),
    (4, "é " * 30_000 + "x@y.zz"),
]


def test_personal_data_rows(spark, field):
    docs = spark.createDataFrame([(*r, 1, "q") for r in PEOPLE], "doc_id long, text string, n_email int, spans string")
    found = sorted(map(tuple, pii.personal_data(docs, field).collect()), key=repr)
    wanted = []
    for id_, text in PEOPLE:
        spans = plain_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in pii.KINDS]
        wanted.append((id_, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert found == sorted(wanted, key=repr)
    assert pii.personal_data(docs.limit(0), field).collect() == []
    clean = pii.redact(docs, field)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {1: None, 2: "", None: "[EMAIL] and [IP]", 3: "card [CARD], [PHONE]", 4: "é " * 30_000 + "[EMAIL]"}


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in found.items())
    truth = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in truth) >= 0.97 * len(truth)
    assert sum(r.predicted == 0 for r, q in truth if q == 1) <= 0.01 * len(truth)


def test_quality_rows(spark):
    rng = random.Random(0)
    good = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)), 1) for k in range(60)]
    bad = [(100 + k, "spam!! " * rng.randint(20, 60), 0) for k in range(60)]
    rows = [*good, *bad, (300, None, None), (301, "", 1), (None, "x", 1), (302, "z " * 400_000, None)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in [*rows, rows[0]]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = quality.score(docs, labels).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((i for i, _, _ in [*rows, rows[0]]), key=repr)
    assert all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.predicted for r in found}
    assert np.mean([by[i] == q for i, _, q in [*good, *bad]]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found if r.predicted), key=repr)
    assert quality.score(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_vectors_are_of_all_documents(spark):
    rows = [(k, f"some words {k} of text", k % 2) for k in range(40)] + [(100, "unseen besides elsewhere", None), (101, "long one " * 9_000, None), (102, None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([r[::2] for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, id_column="doc_id", text_column="text", label_column="quality")
    np.testing.assert_array_equal(model.vectors, quality.word_vectors(pa.array([r[1] for r in rows])))


def test_words_of_equal_shape_are_told_apart():
    words = ["aaa", "bbb", "ccc", "ddd"]
    place = [int(quality._rows(quality._words(np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64))[0])[0]) for w in words]
    index, vectors = quality._index_vectors().astype(float), quality.word_vectors(pa.array(["aaa bbb", "ccc ddd"] * 20))
    own = lambda k: vectors[place[k]] @ index[place[k ^ 1]] / np.linalg.norm(index[place[k ^ 1]])
    assert min(own(k) for k in range(4)) > 0.9


def test_parts_of_a_text_change_no_vector(monkeypatch):
    texts = pa.array(["some words here, and there. " * 60, "other \n" * 300, "", "x"])
    whole = quality.word_vectors(texts)
    monkeypatch.setattr(quality, "_SLICE", 400)
    np.testing.assert_array_equal(quality.word_vectors(texts), whole)


def test_neighbours_do_not_change_the_features():
    texts = pa.array(["some words here", "other words", "", "x y x y"])
    vectors = quality.word_vectors(texts)
    whole = quality.features(texts, vectors)
    np.testing.assert_array_equal(np.vstack([quality.features(texts.slice(k, 1), vectors) for k in range(4)]), whole)


def test_slices_hardly_change_the_features(monkeypatch):
    texts = pa.array(["some words here. " * 50, "other\n" * 300, "", "x"])
    vectors = quality.word_vectors(texts)
    whole = quality.features(texts, vectors)
    monkeypatch.setattr(quality, "_SLICE", 400)
    np.testing.assert_allclose(quality.features(texts, vectors), whole, atol=5e-2)
