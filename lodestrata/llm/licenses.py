"""Licence scan by a trained paragraph classifier (operator 5). DataFrame functions only on the executors.

A paragraph is a line, with the lines that go on from it: a line end is taken for wrapping where the line before it has 40 characters or
more and doesn't end a sentence, and the next isn't blank. Its features are which word 1- and 2-grams it holds. Multinomial logistic
regression with an L1 penalty (so that the model is sparse) gives each licence family, `unknown` and `none` a probability. It is fitted
on the driver: families from the templates below, varied (words dropped, cut, set in prose); unknown from notices of made-up licences
and from halves of two families' notices put together; none from sentences that merely use the words and at most about
`most_negatives` whole paragraphs of the corpus, one a sampled document (documented bound; those like a template left out). A
temperature calibrates the probabilities: it is fitted on fresh variants of notices, a third of them of templates that the model it is
fitted for has not seen, as notices in a corpus are mostly known ones.

A paragraph is reported when `none` is not its likeliest class. Its family is the likeliest class if that one's calibrated probability
reaches `sure` and the paragraph holds `similar` or more of the word pairs of one of the family's templates (or the template holds so
many of the paragraph's); otherwise the family is `unknown`.

Every paragraph is scored, in its row: the model is a few constant arrays, addressed by a hash that is perfect on its n-grams. Of the
n-grams found there the most that each can lift any class over `none` is added up first. Where even that can't make up for the head
start of `none`, the paragraph is `none` without more; for the others the score of each class is taken.

Nulls and edges: null and empty texts have no paragraphs; rows that repeat a doc_id and text are answered once; null ids stay null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

# Notices and characteristic sentences of licence families (fixed values, from the licences' public texts).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2024 The Company. All rights reserved.",
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
    ],
}
# Sentences that use the words without granting anything (training negatives).
OTHER = [
    "She renewed her driving license at the public office on Monday.",
    "The commons committee met to discuss the version of the report.",
    "All the seats are reserved for guests of the wedding.",
    "He studied physics at MIT before moving to a software company.",
    "The Apache helicopter landed on a field.",
    "Copies of the file were sent to the office without restriction.",
    "The general public is free to visit the foundation on Sundays.",
    "Human rights are the subject of the terms of this treaty.",
    "The source of the river was found by any later expedition.",
    "Poetic license allowed the author to modify the terms of the story.",
    "A work of art, released under pressure, may not please.",
    "The restaurant has a licence to serve wine under local law.",
]
# Notices of made-up licences (training of the unknown class); NAME is replaced by random words.
UNKNOWN_NOTICES = [
    "This software is licensed under the NAME License.",
    "Licensed under the NAME Community License, Version 2; you may not use this file except in compliance with that license.",
    "Use of this work is governed by the terms of the NAME Public Agreement.",
    "You may copy and distribute this document under the licence of NAME, see the license for details.",
    "SPDX-License-Identifier: LicenseRef-NAME",
    "Permission to use, copy, modify and distribute this text is granted by NAME for any purpose without fee.",
    "Released under the NAME Licence.",
    "This file is subject to the terms and conditions defined in the NAME license, which is part of this package.",
]
_TOKEN = "[a-z0-9]+"
NONE, UNKNOWN = "none", "unknown"
SLOTS = 1 << 16
_WRAP = r"\n(?<=[^\n]{40}\n)(?<![.!?:]\n)(?=[^\n])"


def py_tokens(line: str) -> list[str]:
    return re.findall(_TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), line))


def py_grams(tokens: list[str]) -> set[str]:
    return {*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))}


@dataclass
class Model:
    classes: list[str]  # families, unknown, none
    vocabulary: list[str]
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float

    @property
    def head_start(self) -> float:
        """How far `none` is ahead of every other class before any n-gram is read."""
        return float(self.bias[-1] - self.bias[:-1].max())

    @property
    def lifts(self) -> np.ndarray:
        """The most that each n-gram lifts any class over none; never less than 0."""
        return np.maximum((self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1), 0)


def _variants(rng: np.random.Generator, family: str, tokens: list[str], prose: list[str], n: int) -> list[tuple[str, list[str]]]:
    out = [(family, tokens)]
    for i in range(n):
        v = [w for w in tokens if rng.random() > 0.08] or tokens
        if i % 3 == 1 and len(v) > 14:
            v = v[: len(v) // 2] if i % 2 else v[len(v) // 2 :]
        if i % 3 == 2:
            p = py_tokens(prose[int(rng.integers(len(prose)))])[:20]
            v = p[: len(p) // 2] + v + p[len(p) // 2 :]
        out.append((family, v))
    return out


def _rows(rng: np.random.Generator, templates: dict[str, list[str]], prose: list[str], n: int) -> list[tuple[str, list[str]]]:
    """(class, tokens) of the positive training rows of some templates."""
    out = []
    for family, texts in templates.items():
        for text in texts:
            out += _variants(rng, family, py_tokens(text), prose, n)
    words = sorted({w for p in prose for w in py_tokens(p)}) or ["some"]
    name = lambda: " ".join(words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(1, 3))))
    for text in UNKNOWN_NOTICES:
        for _ in range(max(1, n // 2)):
            out += _variants(rng, UNKNOWN, py_tokens(text.replace("NAME", name())), prose, 1)
    families = sorted(f for f in templates if templates[f])
    for i, f in enumerate(families):
        a, b = py_tokens(templates[f][0]), py_tokens(templates[families[(i + 1) % len(families)]][0])
        out.append((UNKNOWN, a[: len(a) // 2] + b[len(b) // 2 :]))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    weight = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1)[:, None].astype(np.float32) / y.shape[1]  # every class weighs the same
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    step = 8.0
    for _ in range(steps):
        g = weight * (_softmax(x @ w + b) - y)
        w -= step * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= step * g.sum(axis=0)
    return w, b


def py_similarity(tokens: list[str]) -> float:
    """The largest share of word pairs that a paragraph has in common with a template."""
    own, best = set(zip(tokens, tokens[1:], strict=False)), 0.0
    for texts in TEMPLATES.values():
        for t in texts:
            p = py_tokens(t)
            pairs = set(zip(p, p[1:], strict=False))
            best = max(best, len(own & pairs) / max(1, min(len(own), len(pairs))))
    return best


def fit(negatives: list[str], l1: float = 2e-4, steps: int = 300, variants: int = 12, seed: int = 7) -> Model:
    prose = sorted(x for x in set(negatives) if (t := py_tokens(x)) and py_similarity(t) < 0.5) or OTHER
    classes = [*TEMPLATES, UNKNOWN, NONE]
    none = [(NONE, py_tokens(x)) for x in [*OTHER * 6, *prose]]
    notices = [*(t for texts in TEMPLATES.values() for t in texts), *(t.replace("NAME", "") for t in UNKNOWN_NOTICES), *OTHER]
    vocabulary = sorted({g for t in notices for g in py_grams(py_tokens(t))})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.zeros((len(rows), len(classes)), np.float32)
        for i, (family, t) in enumerate(rows):
            x[i, [at[g] for g in py_grams(t) if g in at]] = 1
            y[i, classes.index(family)] = 1
        return x, y

    # calibration: a family's second template is kept from the model whose probabilities are looked at
    rng = np.random.default_rng(seed)
    seen = {f: [*texts[:1], *texts[2:]] for f, texts in TEMPLATES.items()}
    w, b = _regression(*matrix(_rows(rng, seen, prose, variants) + none[::2]), l1, steps)
    fresh = [(f, t, 4 if i == 1 else 8 // max(1, len(texts) - 1)) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    x, y = matrix([*(r for f, t, n in fresh for r in _variants(rng, f, py_tokens(t), prose, n)[1:]), *none[1::2]])
    weight = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1)[:, None]
    z = x @ w + b
    temperature = float(min(np.linspace(0.25, 4, 31), key=lambda t: -(weight * y * np.log(_softmax(z / t) + 1e-9)).sum()))
    w, b = _regression(*matrix(_rows(np.random.default_rng(seed), TEMPLATES, prose, variants) + none), l1, steps)
    used = np.flatnonzero((w != 0).any(axis=1))
    return Model(classes, [vocabulary[i] for i in used], w[used], b, temperature)


def tokens_of(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))


def pairs_of(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text in order, wrapped lines joined by a space."""
    return F.split(F.regexp_replace(text, _WRAP, " "), "\n")


def train(docs: DataFrame, most_negatives: int = 1000) -> Model:
    """Negatives: a whole paragraph, by hash of the id, of each of at most about so many documents."""
    n = docs.select("doc_id").count()
    rows = docs if n <= most_negatives else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_negatives / n))
    rows = rows.where("text is not null").select("doc_id", paragraphs(F.col("text")).alias("p"))
    return fit([r[0] for r in rows.select(F.get("p", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.size("p")).cast("int"))).collect()])


class Scorer:
    """The model as expressions on a paragraph's tokens."""

    def __init__(self, model: Model, spark: SparkSession):
        self.model = model
        grams = spark.createDataFrame([(g,) for g in model.vocabulary], "g string")
        for seed in range(1000):
            slot = lambda g, seed=seed: F.pmod(F.xxhash64(F.lit(seed), g), F.lit(SLOTS)).cast("int")
            where = {r[0]: r[1] for r in grams.select("g", slot(F.col("g"))).collect()}
            if len(set(where.values())) == len(model.vocabulary):
                break
        else:
            raise ValueError("no perfect hash: too many n-grams")
        self.slot = slot
        index = np.full(SLOTS, -1)
        for i, g in enumerate(model.vocabulary):
            index[where[g]] = i
        constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        self.index, self.vocabulary = constant(index.tolist(), "int"), constant(model.vocabulary, "string")
        self.lifts = constant((np.ceil(model.lifts * 1e6) / 1e6).tolist(), "double")
        self.weights = constant(model.weights.astype(float).tolist(), "array<double>")

    def held(self, tokens: Column) -> Column:
        """The places in the vocabulary of the distinct words and word pairs that are in it."""
        place = lambda g: F.get(self.index, self.slot(g))
        near = let(tokens, lambda t: F.filter(F.concat(t, pairs_of(t)), lambda g: place(g) >= 0))
        known = F.filter(near, lambda g: F.get(self.vocabulary, place(g)) == g)
        return F.array_distinct(F.transform(known, place))

    def lift(self, held: Column) -> Column:
        return F.aggregate(held, F.lit(0.0), lambda acc, i: acc + F.get(self.lifts, i))

    def reported(self, held: Column) -> Column:
        """The numbers of all classes, or null where none's is the largest."""
        k, enough = len(self.model.classes), self.lift(held) >= self.model.head_start - 1e-4
        return F.when(enough, let(self.scores(held), lambda z: F.when(F.get(z, F.lit(k - 1)) < F.array_max(F.slice(z, 1, k - 1)), z)))

    def scores(self, held: Column) -> Column:
        """A number for each class."""
        bias = F.array(*[F.lit(float(b)) for b in self.model.bias])
        return F.aggregate(held, bias, lambda acc, i: F.zip_with(acc, F.get(self.weights, i), lambda a, w: a + w))


def scan_licenses(docs: DataFrame, model: Model | None = None, sure: float = 0.5, similar: float = 0.6) -> DataFrame:
    """doc_id, para_no, family, probability, template_similarity, confirmed, paragraph of every paragraph reported."""
    spark = docs.sparkSession
    m = model or train(docs)
    scorer, k = Scorer(m, spark), len(m.classes)
    paras = docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("para_no", "line"))
    # few rows pass, so that what the filter computes is computed again for those alone
    scored = paras.withColumn("z", let(scorer.held(tokens_of(F.col("line"))), scorer.reported)).where("z is not null")
    top = F.array_max("z")
    scored = scored.withColumn("e", F.transform("z", lambda z: F.exp((z - top) / m.temperature)))
    sums = scored.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).withColumn("p", F.transform("e", lambda x: x / F.col("total")))
    best = F.array_max(F.slice("p", 1, k - 1))
    out = sums.withColumn("probability", best).withColumn("likeliest", F.element_at(F.array(*map(F.lit, m.classes)), F.array_position("p", F.array_max(F.slice("p", 1, k - 1))).cast("int")))
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "likeliest string, template string")
    templates = templates.select("likeliest", F.array_distinct(pairs_of(tokens_of(F.col("template")))).alias("tp"))
    templates = templates.groupBy("likeliest").agg(F.collect_list("tp").alias("tps"))  # one row a family
    own = F.array_distinct(pairs_of(tokens_of(F.col("line"))))
    out = out.join(F.broadcast(templates), "likeliest", "left").withColumn("own", own)
    share = F.transform("tps", lambda t: F.size(F.array_intersect(t, F.col("own"))) / F.greatest(F.least(F.size(t), F.size("own")), F.lit(1)))
    out = out.withColumn("template_similarity", F.coalesce(F.array_max(share), F.lit(0.0)))
    confirmed = (F.col("likeliest") != UNKNOWN) & (F.col("probability") >= sure) & (F.col("template_similarity") >= similar)
    return out.select(
        "doc_id",
        "para_no",
        F.when(confirmed, F.col("likeliest")).otherwise(UNKNOWN).alias("family"),
        "probability",
        "template_similarity",
        confirmed.alias("confirmed"),
        F.col("line").alias("paragraph"),
    ).distinct()


def op5_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
