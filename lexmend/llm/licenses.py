"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph ends at a line without letters and digits, and at a line end behind an end mark (.!?);
other line ends are wrapped lines of one paragraph, so a notice in a source header is one paragraph
however it is wrapped or commented out. A multinomial logistic regression over its word uni- and
bigrams, made sparse by an L1 penalty, tells licence families from the unknown class. It is
trained on the driver from the template sentences below (whole, cut and embedded in other words),
from sentences that speak of licences without granting one, and from a bounded sample of the
corpus's own paragraphs that hold no run of a template (``background_docs`` documents, whole, and
``background_paragraphs`` of their paragraphs, whole, of which only the n-grams of the vocabulary
reach the driver). The logits are calibrated by a temperature fitted on held-out examples; a
paragraph whose likeliest family stays under ``least_chance`` is unknown.

A prediction is confirmed if the paragraph holds a template of that family word for word, or if at
least 0.8 of its five-word shingles occur in the family's templates (shorter paragraphs count as
one shingle). A document's licence is its likeliest confirmed family; one with predictions that
no template confirms is ``unknown``.

Scoring is one projection of built-in functions. The vocabulary has no n-gram made up of
``STOP_WORDS`` alone, so a text without any other word of it has no feature at all; its paragraphs
are unknown by the model itself, and it skips the scoring. Nothing else depends on how frequent a word is.

Defined cases: null and empty texts have no licence. Texts are read whole, however long. Of families
with the same chance in one paragraph the first in the order of ``TEMPLATES`` counts, of paragraphs
with the same chance the first. Repeated rows are judged alike. Empty tables give empty results; an
empty background leaves templates and near misses. Columns other than id and text, of any name, are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.common import as_text

TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Between paragraphs. Java and the engine of the tests read it alike.
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+|(?<=[.!?][^\p{L}\p{N}\n]{0,6})\n"
SHINGLE, LEAST_SHARED = 5, 0.8
UNKNOWN = "unknown"
#: Words that tell nothing on their own.
STOP_WORDS = frozenset(
    "a about all also an and any are as at be been but by can do for from has have he her his if in into is it its may more no not of on one or other "
    "our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()
)

#: Notices and distinctive sentences of public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying or distribution is strictly prohibited.",
    ),
}

#: Names that short notices use, and the notices. Names of no family here belong to the unknown class.
NAMES = {
    "mit": ("MIT", "MIT/X11"),
    "apache": ("Apache", "Apache 2.0"),
    "gpl": ("GPL", "GPLv3", "GNU GPL", "GNU General Public"),
    "lgpl": ("LGPL", "GNU LGPL", "GNU Lesser General Public"),
    "bsd": ("BSD", "3-Clause BSD", "2-Clause BSD"),
    "mpl": ("MPL", "MPL 2.0", "Mozilla Public"),
    "cc-by": ("CC BY", "Creative Commons Attribution"),
    "cc-by-sa": ("CC BY-SA", "Creative Commons Attribution-ShareAlike"),
    "cc-by-nc": ("CC BY-NC", "Creative Commons Attribution-NonCommercial"),
    "public-domain": ("CC0", "Unlicense"),
}
OTHER_NAMES = ("EUPL", "zlib", "Artistic", "Eclipse Public", "OFL", "company", "vendor", "WTFPL", "Boost Software", "PostgreSQL")
NOTICES = (
    "Released under the {} license.",
    "Licensed under {}.",
    "This file is distributed under the terms of the {} license.",
    "This project is available under the {} License; see the LICENSE file.",
)

#: Sentences near the subject that grant nothing.
NEAR_MISSES = (
    "You need a driving license to rent a car at the airport.",
    "The office renews your fishing licence within two weeks.",
    "She asked for permission to leave the room early.",
    "The public library is free and open to any person in the city.",
    "The Apache people lived in the south west of the country.",
    "He studied physics at MIT before he moved to Boston.",
    "The software version 2.0 was published last year.",
    "Please read the terms and conditions before you buy a ticket.",
    "The general public was not allowed to enter the building.",
    "They work under a new contract with the union.",
    "A copy of the letter was distributed to all members.",
    "The restaurant lost its license to serve alcohol.",
    "Warranty claims must include the original receipt.",
    "The foundation supports creative projects in common spaces.",
    "Version 3 of the report includes the source of each number.",
    "The court confirmed the rights of the author and the publisher.",
)


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def paragraphs(text: str) -> list[str]:
    return regex.split(PARAGRAPH, text)


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def shingles(words: list[str]) -> set[str]:
    if not words:
        return set()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def texts_of(family: str) -> list[str]:
    """The templates of a family: its sentences, and the notices with its names."""
    return [*TEMPLATES[family], *(n.format(name) for name in NAMES.get(family, ()) for n in NOTICES)]


def template_shingles(family: str) -> set[str]:
    return {s for t in texts_of(family) for s in shingles(tokens(t))}


def vocabulary() -> list[str]:
    """The n-grams of the templates that hold a word that isn't a stop word."""
    return sorted({g for f in TEMPLATES for t in texts_of(f) for g in grams(tokens(t)) if set(g.split()) - STOP_WORDS})


def confirms(words: list[str], family: str) -> bool:
    """Whether the templates of a family confirm a paragraph of these words."""
    own, text = shingles(words), f" {' '.join(words)} "
    return len(own & template_shingles(family)) >= LEAST_SHARED * len(own) or any(f" {' '.join(tokens(t))} " in text for t in texts_of(family))


@dataclass(frozen=True)
class LicenseModel:
    """``weights`` maps an n-gram to its weight for every class; the last class is the unknown one."""

    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: tuple[float, ...]
    words: tuple[str, ...]

    def chances(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in sorted(grams(words)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def examples(background: list[list[str]], seed: int = 5) -> tuple[list[set[str]], list[str]]:
    """Training paragraphs as n-grams, and their classes: templates whole, cut and embedded; near misses; background."""
    pick = np.random.default_rng(seed)
    # Words that the corpus shares with templates, among as many that have no feature.
    shared = [g for own in background for g in own if " " not in g]
    filler = [*shared, *["~"] * (len(shared) + 1)]
    extra = lambda n: [filler[int(j)] for j in pick.integers(0, len(filler), n)]
    xs, ys = [], []
    for family in TEMPLATES:
        for words in map(tokens, texts_of(family)):
            for i in range(8):
                own = list(words)
                if i > 3 and len(own) > 8:
                    n = int(pick.integers(max(6, len(own) * 4 // 10), len(own) + 1))
                    at = int(pick.integers(0, len(own) - n + 1))
                    own = own[at : at + n]
                if i % 2:
                    more = extra(int(pick.integers(1, 12)))
                    own = [*more, *own] if i % 4 == 1 else [*own, *more]
                xs.append(grams(own))
                ys.append(family)
    for words in map(tokens, [*NEAR_MISSES, *(n.format(name) for name in OTHER_NAMES for n in NOTICES)]):
        for i in range(4):
            xs.append(grams([*extra(i), *words]))
            ys.append(UNKNOWN)
    return xs + [set(own) for own in background], ys + [UNKNOWN] * len(background)


def fit(background: list[list[str]], l1: float = 2e-4, steps: int = 300, seed: int = 5) -> LicenseModel:
    """Train with ``background``, the n-grams of :func:`vocabulary` in paragraphs without a licence."""
    vocab = vocabulary()
    at = {g: i for i, g in enumerate(vocab)}
    xs, ys = examples(background, seed)
    classes = (*TEMPLATES, UNKNOWN)
    x = np.zeros((len(xs), len(vocab)), np.float32)
    for i, own in enumerate(xs):
        x[i, [at[g] for g in own if g in at]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for c in ys]]
    held = np.arange(len(xs)) % 5 == 0
    balance = (1 / np.maximum(y.sum(axis=0), 1))[y.argmax(axis=1)]
    balance /= balance.mean()

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    w, b = np.zeros((len(vocab), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    tx, ty, tb = x[~held], y[~held], balance[~held][:, None]
    rate = 2.0
    for _ in range(steps):
        error = (softmax(tx @ w + b) - ty) * tb / len(tx)
        w -= rate * (tx.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * error.sum(axis=0)
    # Temperature of least held-out log loss.
    z, truth = x[held] @ w + b, y[held].argmax(axis=1)
    loss = {t: -float(np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-9).mean()) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    warm = min(loss, key=loss.get)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    weights = {vocab[i]: [round(float(v), 6) for v in w[i] / warm] for i in used}
    words = sorted({t for g in weights for t in g.split()} - STOP_WORDS)
    return LicenseModel(classes, weights, tuple(round(float(v), 6) for v in b / warm), tuple(words))


def literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def find_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(t: Column) -> Column:
    pairs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(t) > 1, F.array_distinct(F.concat(t, pairs))).otherwise(t)


def runs(t: Column) -> Column:
    last = F.greatest(F.size(t) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(t, i, F.lit(SHINGLE)), " ")))


def sample_background(df: DataFrame, text_col: str = "text", background_docs: int = 400, background_paragraphs: int = 3000) -> list[list[str]]:
    """The vocabulary's n-grams in paragraphs of a bounded sample of documents, the same on every run. Paragraphs that hold a run of a template are no background."""
    text = as_text(F.col(text_col))
    # The hash thins out the rows first, so that few are looked at and few reach the driver from however many tasks.
    share = min(1.0, background_docs / max(df.count(), 1))
    picked = df.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    known = literal(sorted(set().union(*map(template_shingles, TEMPLATES))), "array<string>")
    found = picked.select(F.explode(F.split(text, PARAGRAPH)).alias("p")).select(F.xxhash64("p").alias("h"), find_tokens(F.col("p")).alias("t"))
    found = found.filter((F.size("t") > 0) & ~F.arrays_overlap(runs(F.col("t")), known))
    found = found.select("h", F.array_sort(F.array_intersect(ngrams(F.col("t")), literal(vocabulary(), "array<string>"))).alias("own")).distinct()
    return [r["own"] for r in found.orderBy("h", "own").limit(background_paragraphs).collect()]  # at most so many rows, each a part of the vocabulary


def scan_licenses(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least_chance: float = 0.7) -> DataFrame:
    """One row for each row of ``df``: id, license (likeliest confirmed family, ``unknown`` or ``none``), score, paragraphs.

    ``paragraphs`` lists (paragraph, family, score, confirmed) of the paragraphs with a family of at
    least ``least_chance``; ``unknown`` are texts without a confirmed one, but with a paragraph whose likeliest class is a family.
    """
    words = literal(list(model.words), "array<string>")
    weights = literal(model.weights, "map<string,array<double>>")
    held = literal(list(model.weights), "array<string>")
    families = literal(list(model.classes), "array<string>")
    bias = literal(list(model.bias), "array<double>")
    known = literal({f: sorted(template_shingles(f)) for f in TEMPLATES}, "map<string,array<string>>")
    whole = literal({f: [f" {' '.join(tokens(t))} " for t in texts_of(f)] for f in TEMPLATES}, "map<string,array<string>>")

    def judged(p: Column, number: Column) -> Column:
        logits = lambda t: F.aggregate(F.array_intersect(ngrams(t), held), bias, lambda z, g: F.zip_with(z, F.element_at(weights, g), lambda a, b: a + b))
        chance = lambda z: F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(z)))
        best = lambda z: F.element_at(families, F.array_position(z, F.array_max(z)).cast("int"))
        shared = lambda t, f: bind(runs(t), lambda s: F.size(F.array_intersect(s, F.element_at(known, f))) >= F.size(s) * LEAST_SHARED)
        holds = lambda t, f: bind(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), lambda x: F.exists(F.element_at(whole, f), lambda y: F.contains(x, y)))

        def told(x: Column) -> Column:
            sure = F.when(x["family"] != UNKNOWN, shared(x["t"], x["family"]) | holds(x["t"], x["family"])).otherwise(F.lit(False))
            return F.struct(number.cast("int").alias("paragraph"), x["family"].alias("family"), x["score"].alias("score"), sure.alias("confirmed"))

        scored = bind(F.struct(p.alias("t"), logits(p).alias("z")), lambda x: F.struct(x["t"].alias("t"), best(x["z"]).alias("family"), chance(x["z"]).alias("score")))
        return bind(scored, told)

    text = F.col("_text")
    empty = F.array().cast("array<struct<paragraph:int,family:string,score:double,confirmed:boolean>>")
    found = F.transform(F.split(text, PARAGRAPH), lambda p: find_tokens(p))
    scored = F.filter(F.transform(found, lambda t, i: F.when(F.arrays_overlap(t, words), judged(t, i))), lambda x: x.isNotNull() & (x["family"] != UNKNOWN))
    best = F.reduce(F.col("_sure"), F.struct(F.lit("").alias("family"), F.lit(0.0).alias("score")), lambda a, x: F.when(x["confirmed"] & (x["score"] > a["score"]), F.struct(x["family"].alias("family"), x["score"].alias("score"))).otherwise(a))
    return (
        df.select(F.col(id_col).alias("_id"), as_text(F.col(text_col)).alias("_text"))
        .withColumn("_any", F.when(F.arrays_overlap(find_tokens(text), words), scored).otherwise(empty))
        .withColumn("_sure", F.filter("_any", lambda x: x["score"] >= least_chance))
        .withColumn("_best", best)
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_best.score") > 0, F.col("_best.family")).when(F.size("_any") > 0, F.lit(UNKNOWN)).otherwise(F.lit("none")).alias("license"),
            F.round("_best.score", 6).alias("score"),
            F.col("_sure").alias("paragraphs"),
        )
    )
