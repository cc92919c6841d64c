"""Licence notices by a trained paragraph classifier, confirmed by templates.

A paragraph reaches to the next line without a letter or digit, so a notice may be wrapped and stand in comment marks.
It is looked at in windows of ``WINDOW`` words, each overlapping the next by half.  A window's features are the distinct word
pairs that occur in it.  A multinomial logistic regression, kept sparse by an L1 penalty, gives a score for each licence
family and for ``unknown``; a temperature fitted on held-out examples turns the scores into calibrated
probabilities.  The likeliest family, if it is likelier than ``PROBABLE`` against ``unknown``, is confirmed by one of its
templates: enough of the template's word pairs must occur in the window, and all of those with a digit, so that a
version is only reported where it is stated.  The pairs of that family's templates are then taken out and what is left is
looked at again, ``FAMILIES`` times in all, as a sentence may offer a choice of licences.

The model is fitted on the small table ``examples()`` and has a few hundred weights, which is all
that is broadcast.  A word pair without a weight adds nothing, so windows without any known pair
score the bias alone, which is ``unknown`` (checked when the model is fitted): they drop out of the
join without a loss.  The main path is DataFrame functions only.

Defined results: null and empty texts have no notices; one row per document, paragraph and family found, that of the
most similar window (the first of equals), rows with equal id and text counting once; null ids are kept as null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.words import each_place, gram
from promptloom.session import cut

PROBABLE, SIMILAR = 0.5, 0.75
#: Words of a window, half of which the next one repeats: longer than twice any template.
WINDOW = 80
#: Families looked for in one window.
FAMILIES = 3
UNKNOWN = "unknown"

#: Names under which the licence families are known.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "the MIT License (MIT)", "Expat MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License", "Apache Software License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPL-2.0 license", "GPLv2 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPL-3.0 license", "GPLv3 license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL license", "LGPL-3.0 license"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL license", "AGPL-3.0 license"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "new BSD license", "simplified BSD license", "BSD-style license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0 license", "MPL 2.0 license"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["Unlicense license", "the Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0", "CC0 public domain dedication"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution ShareAlike license"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
}
#: Sentences of the licences' own texts.
CLAUSES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
}
_FRAMES = [
    "{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This project is distributed under the terms of the {}.", "This file is made available under the {}.", "License: {}",
]
_OTHER = [
    "All rights reserved.", "This work is not licensed to anyone.", "The driving license was issued under the old law.",
    "Released under the new label in spring.", "Licensed under a private contract.", "Licensed under the terms of the agreement.",
    "This work is distributed to all members.", "The general public was not admitted.", "A public license to trade was granted.",
    "The source of the river is in the hills.", "Permission was granted by the mayor.", "Free of charge for any person under ten.",
    "Version 2.0 of the report is out.", "Version 3 of the plan was released.", "The creative commons room is on the first floor.",
    "This project is released today.", "This file is available to all.", "A license is required.", "License: none",
    "The MIT campus lies by the river.", "The Apache people lived in the plains.", "Mozilla published a report.",
    "General public opinion on version 3 is divided.", "Subject to the terms of the sale.", "Attribution of the painting is disputed.",
    "The software was copied without fee.", "The universal remote costs 1.0 units.", "They use the file in compliance with the rules.",
]
#: Pairs of these alone are no features.
_COMMON = set(
    "a an the of to in on at by for from with without and or not is are was be it this that these those as any all you your we our"
    " no if into than then there their has have had he she they his her its which who what when will would can may 0 1 2 3 4".split()
)


def examples() -> list[tuple[str, str]]:
    """The labelled table: (family, paragraph)."""
    rows = [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in _FRAMES]
    rows += [(family, text) for family, texts in CLAUSES.items() for text in texts]
    return rows + [(UNKNOWN, text) for text in _OTHER]


def _words(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return kept.split()


def pairs(text: str) -> set[tuple[str, str]]:
    words = _words(text)
    return {p for p in zip(words, words[1:], strict=False) if not set(p) <= _COMMON}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: tuple[tuple[str, frozenset], ...]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regress(x: np.ndarray, y: np.ndarray, n: int, steps: int = 400, rate: float = 2.0, penalty: float = 3e-4):
    """Proximal gradient: a step down the loss, then the weights shrink towards 0; classes weigh the same."""
    weights, bias, truth = np.zeros((x.shape[1], n)), np.zeros(n), np.eye(n)[y]
    each = (1 / np.bincount(y, minlength=n).clip(1))[y][:, None] / n
    for _ in range(steps):
        error = (_softmax(x @ weights + bias) - truth) * each
        weights -= rate * 4 * (x.T @ error)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * penalty, 0)
        bias -= rate * error.sum(axis=0)
    return weights, bias


def fit() -> Model:
    """Fits on the labelled table; the temperature is chosen on the folds that a fit left out."""
    rows = examples()
    families = (*NAMES, UNKNOWN)
    y = np.array([families.index(f) for f, _ in rows])
    found = [pairs(t) for _, t in rows]
    known = sorted(set().union(*found))
    place = {p: k for k, p in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for k, some in enumerate(found):
        x[k, [place[p] for p in some]] = 1
    fold = np.arange(len(rows)) % 4
    scores = np.zeros((len(rows), len(families)))
    for k in range(4):
        weights, bias = _regress(x[fold != k], y[fold != k], len(families))
        scores[fold == k] = x[fold == k] @ weights + bias
    grid = np.geomspace(0.2, 5, 33)
    loss = [-np.log(_softmax(scores / t)[np.arange(y.size), y].clip(1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    weights, bias = _regress(x, y, len(families))
    # nothing known of a paragraph must mean unknown: the bias of that class is raised to it if need be
    bias[-1] = max(bias[-1], bias[:-1].max() + 2 * temperature)
    used = np.abs(weights).max(axis=1) > 0
    templates = tuple(
        (family, frozenset(pairs(t))) for family in NAMES for t in [*NAMES[family], *CLAUSES.get(family, [])] if pairs(t)
    )
    return Model(families, tuple(p for p, u in zip(known, used, strict=True) if u), weights[used], bias, temperature, templates)


def _paragraph_words(paragraph: Column) -> Column:
    return F.array_remove(F.split(F.lower(paragraph), "[^a-z0-9]+"), "")


def _best_family(windows: DataFrame, scored: list[str], model: Model, probable: float) -> DataFrame:
    """``family`` and ``probability`` against unknown of windows with summed scores."""
    top, unknown = F.greatest(*scored), F.col(scored[-1])
    family = F.coalesce(*[F.when(F.col(s) == top, F.lit(f)) for s, f in zip(scored, model.families, strict=True)])
    named = windows.withColumns({"family": family, "probability": 1 / (1 + F.exp((unknown - top) / model.temperature))})
    return named.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= probable))


def notices(
    docs: DataFrame, model: Model | None = None, *, id_column: str = "doc_id", text_column: str = "text",
    probable: float = PROBABLE, similar: float = SIMILAR,
) -> DataFrame:
    """Id, paragraph_no (from 0), family, probability, similarity to the nearest template, and first_word of the window."""
    spark, model = docs.sparkSession, model or fit()
    n, half = len(model.families), WINDOW // 2
    scored = [f"s{k}" for k in range(n)]
    known = {p: tuple(map(float, w)) for p, w in zip(model.pairs, model.weights, strict=True)}
    for _, template in model.templates:
        for p in template:
            known.setdefault(p, (0.0,) * n)
    fields = "first string, second string, " + ", ".join(f"{s} double" for s in scored)
    table = spark.createDataFrame([(*p, *w) for p, w in sorted(known.items())], fields)
    table = table.select(F.xxhash64("first", "second").alias("h"), F.concat_ws(" ", "first", "second").alias("pair"), *scored)
    model_pairs = F.broadcast(table)  # some hundred rows
    joined = [(f, sorted(" ".join(p) for p in t)) for f, t in model.templates]
    stated = [(f, t, [p for p in t if any(c.isdigit() for c in p)]) for f, t in joined]
    templates = F.broadcast(spark.createDataFrame(stated, "family string, template array<string>, stated array<string>"))
    owned = [(f, sorted({p for g, t in joined if g == f for p in t})) for f in NAMES]
    own_pairs = F.broadcast(spark.createDataFrame(owned, "family string, own array<string>"))

    paragraphs = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("text_no"),
        F.posexplode(F.split(F.col(text_column).cast("string"), "\n(?:[^A-Za-z0-9\n]*\n)+")).alias("paragraph_no", "paragraph"),
    )
    placed = paragraphs.withColumn("words", _paragraph_words(F.col("paragraph"))).withColumn("at", each_place(F.size("words") - 1))
    hits = placed.withColumn("h", gram("words", "at", 2)).join(F.broadcast(table.select("h")), "h", "left_semi")
    # a pair lies in the window that begins in its own half, and in the one before unless it leaves that
    own_half = F.floor(F.col("at") / half)
    also = F.when((own_half > 0) & (F.col("at") + 1 < (own_half + 1) * half), own_half - 1)
    key = ["id", "text_no", "paragraph_no", "window"]
    window = F.explode(F.array_compact(F.array(own_half, also))).alias("window")
    # few beside the text, and read twice a round
    left = cut(hits.select("id", "text_no", "paragraph_no", "h", window).distinct().join(model_pairs, "h").drop("h"))

    found = None
    for _ in range(FAMILIES):
        summed = left.groupBy(*key).agg(
            F.collect_set("pair").alias("pairs"), *[(F.sum(s) + F.lit(float(b))).alias(s) for s, b in zip(scored, model.bias, strict=True)]
        )
        named = _best_family(summed, scored, model, probable).select(*key, "pairs", "family", "probability")
        likely = named.join(templates, "family").filter(F.size(F.array_except("stated", "pairs")) == 0)  # a few rows a family
        share = F.size(F.array_intersect("pairs", "template")) / F.size("template")
        part = likely.groupBy(*key, "family", "probability").agg(F.max(share).alias("similarity"))
        part = part.filter(F.col("similarity") >= similar)
        found = part if found is None else found.unionByName(part)
        # what is left without the pairs of the family looked at, confirmed or not
        taken = named.join(own_pairs, "family").select(*[F.col(c).alias(f"_{c}") for c in key], "own")
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        left = cut(left.join(taken, same).filter(~F.array_contains("own", F.col("pair"))).select(*key, "pair", *scored))
    first_word = (F.col("window") * half).cast("int").alias("first_word")
    best = F.min(F.struct((-F.col("similarity")).alias("d"), first_word, "probability")).alias("best")
    best = found.groupBy("id", "text_no", "paragraph_no", "family").agg(best)
    return best.select(
        F.col("id").alias(id_column), "paragraph_no", "family", "best.probability", (-F.col("best.d")).alias("similarity"), "best.first_word"
    )
