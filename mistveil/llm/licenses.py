"""Licence scan: a sparse word n-gram logistic regression over paragraphs, confirmed by comparison with templates.

The model is trained in numpy on variations of the notices below; scanning uses DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of licence notices of no known family, and class of all other text.
UNKNOWN, NONE = "unknown", "none"
#: What short notices call the licences of a family, and their SPDX identifiers.
NAMES = {
    "agpl": ["the GNU Affero General Public License, version 3", "the AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["the Apache License, Version 2.0", "the Apache License", "the Apache 2.0 license", "Apache-2.0", "Apache 2.0"],
    "artistic": ["the Artistic License 2.0", "the Artistic License", "Artistic-2.0", "the Perl Artistic License"],
    "boost": ["the Boost Software License, Version 1.0", "the Boost License", "BSL-1.0"],
    "bsd": ["the BSD License", "a BSD-style license", "the 3-Clause BSD License", "the 2-Clause BSD License", "the New BSD License", "BSD-3-Clause", "BSD-2-Clause", "the simplified BSD License"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0", "CC0-1.0", "CC0", "CC0 1.0 Universal Public Domain Dedication"],
    "cddl": ["the Common Development and Distribution License", "the CDDL", "CDDL-1.0", "CDDL 1.1"],
    "epl": ["the Eclipse Public License 2.0", "the Eclipse Public License v1.0", "EPL-2.0", "EPL-1.0", "the EPL"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License", "the GPL, version 2 or later", "the GPL", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0-only"],
    "isc": ["the ISC License", "ISC"],
    "lgpl": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "the LGPL", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only"],
    "mit": ["the MIT License", "the MIT license", "MIT", "an MIT-style license"],
    "mpl": ["the Mozilla Public License 2.0", "the Mozilla Public License", "MPL-2.0", "the MPL"],
    "unlicense": ["the Unlicense", "Unlicense"],
    "zlib": ["the zlib License", "Zlib", "the zlib/libpng License"],
    UNKNOWN: ["the Academic Free License", "AFL-3.0", "the Open Software License 3.0", "the Microsoft Public License", "Ms-PL", "the European Union Public Licence", "EUPL-1.2", "the SIL Open Font License", "OFL-1.1", "the CeCILL license", "the Q Public License", "the Python Software Foundation License", "the Zope Public License", "the Sleepycat License", "the license in the LICENSE file", "the terms of our license agreement", "the Open Data Commons License", "its own public license", "WTFPL"],
}
#: Forms of short notices. The last one takes identifiers only.
FORMS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is released under {}.", "Distributed under the terms of {}. See the LICENSE file for details.", "License: {}", "SPDX-License-Identifier: {}"]
#: Paragraphs of notices and licence texts by family.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "artistic": ["This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself, that is the Artistic License."],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "cc-by": ["Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["You may share and adapt the material for noncommercial purposes only, under a Creative Commons Attribution-NonCommercial License."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-2.0"],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, see http://www.gnu.org/licenses",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "No part of this work may be reproduced without the prior written permission of the copyright holder. All rights reserved.",
        "This software is confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    UNKNOWN: [
        "This file is part of the distribution and may be used under the terms of the license that accompanies it.",
        "By using this software you agree to be bound by the terms of this license agreement.",
        "See the file COPYING for the license under which you may redistribute this package.",
        "You are granted a limited, non-exclusive licence to use the data for research.",
    ],
}
#: Sentences with such words that are no licence notice.
OTHERS = [
    "She renewed her driving license last week.", "The officer asked for a license plate and registration.", "The restaurant lost its liquor license in May.",
    "They fought for civil rights and equal pay.", "Human rights groups met in the capital.", "The table is reserved for six people.", "Two seats were reserved near the window.",
    "The teacher gave permission to leave early.", "Without permission nobody may enter the building.", "The Apache people lived in the southwest.", "An Apache helicopter landed at the base.",
    "The gnu is a large antelope of the plains.", "The car comes with a five year warranty.", "Copyright law is a difficult subject for students.", "Creative people often work at night.",
    "The house of commons debated the bill.", "The redistribution of wealth was a topic of the debate.", "Public parks are open to general visitors.", "A licensed electrician repaired the wiring.",
    "The software crashed again this morning.", "Mozilla published a new browser release.", "The driver was licensed and insured.", "Please reserve all rights of way for cyclists.",
    "The general asked the public for calm.", "The source of the river is in the hills.", "He was free of charge and left the court.", "Version two of the plan was better.",
    "Install the software with the package manager and restart the program.", "A copy of the report was sent to the author.", "The source code is split into files by module.", "Distribution of the goods begins in spring.",
    "The terms of the contract were agreed in writing.", "He holds a degree from MIT and teaches at the institute.", "The foundation published a free guide for the public.", "The version in the file is newer than the version on the site.",
    "Use of the library is free for students.", "The implied meaning was lost on the person.", "Any later date is fine with the committee.", "The work was released in March and sold many copies.", "You should have received a letter along with this parcel.",
    "The product is provided with a manual and a cable.", "The files are included in the documentation.", "The public domain of the duke ended at the river.", "The zlib module compresses data.", "The eclipse was visible in the north.", "Her artistic work was shown in a gallery.",
    "The notice on the door was above the bell.", "The authors thank all contributors for their help.", "The damages were paid by the insurance.", "Conditions at the camp were met with concern.", "A boost in sales helped the company.", "The lesser of two evils won the vote.",
]
#: Words that say nothing by themselves, and digits; n-grams of these alone are no features.
COMMON = frozenset(
    "a all an and any are as at be been being better but by can each for from has have if in into is it its may more most must new no not of on only or other our own part same see should so some such"
    " than that the their then there they this to under use used was we were when which while who will with without you your 0 1 2 3 4 5 6 7 8 9".split()
)
#: Least probability of a class, and least share of the word pairs of the shorter of window and template that they have in common.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.6
#: Words of a window, and from one to the next, where a paragraph is longer.
WINDOW, STEP = 64, 32
ORDERS, VARIANTS, ROUNDS, RATE, SHRINK, SEED = (1, 2, 3), 8, 250, 4.0, 4e-5, 3

_WORD = "[a-z0-9]+"
#: Between paragraphs: lines without a letter or digit.
_BLANK = r"\n(?:[^\p{L}\p{Nd}\n]*\n)+"


def templates() -> dict[str, list[str]]:
    """Notices by class: each name in each form (identifiers also as SPDX tags), and the paragraphs."""
    out = {f: list(NOTICES.get(f, [])) for f in {*NAMES, *NOTICES}}
    for f, names in NAMES.items():
        out[f] += [form.format(n) for n in names for form in FORMS if "SPDX" not in form or " " not in n]
    return out


def grams_of(words: list[str]) -> set[str]:
    """The n-grams of a window that may be features."""
    return {" ".join(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1) if not COMMON.issuperset(words[i : i + n])}


@dataclass
class LicenceModel:
    families: list[str]  # the last are UNKNOWN and NONE
    weights: dict[str, list[float]]  # of each n-gram, by class
    bias: list[float]
    gate: list[str]  # without one of these words no window gets from NONE to another class


def _varied(rng: np.random.Generator, text: str, filler: list[str]) -> list[str]:
    """Words of a text, perhaps a part of it, some left out, perhaps among other words."""
    words = re.findall(_WORD, text.lower())
    if len(words) > 16 and rng.random() < 0.4:  # as where a window cuts a notice
        n = int(rng.integers(12, len(words)))
        at = int(rng.integers(0, len(words) - n + 1))
        words = words[at : at + n]
    words = [w for w in words if rng.random() > 0.04] or words
    before, after = (list(rng.choice(filler, rng.integers(1, 24))) if rng.random() < 0.4 else [] for _ in range(2))
    return before + words + after


@dataclass
class _Sparse:
    """Rows of ones: the features of all rows one after the other, and where each row begins; the same by feature."""

    features: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    used: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(rows: list[list[int]]) -> _Sparse:
        sizes = np.array([len(r) for r in rows])
        features, row = np.concatenate([np.array(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(features, kind="stable")
        used, begins = np.unique(features[order], return_index=True)
        return _Sparse(features, np.cumsum(sizes) - sizes, row[order], used, begins)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.features], self.starts)

    def gradient(self, p: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, p.shape[1]), np.float32)
        out[self.used] = np.add.reduceat(p[self.rows], self.begins)
        return out


def _fit(x: _Sparse, y: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient descent with shrinkage; classes weigh alike, but NONE, the last, as half of all."""
    share = np.full(k, 0.5 / (k - 1), np.float32)
    share[-1] = 0.5
    mass = (share / np.maximum(np.bincount(y, minlength=k), 1))[y][:, None] * len(y)
    target = np.eye(k, dtype=np.float32)[y]
    w, bias = np.zeros((n, k), np.float32), np.zeros(k, np.float32)
    bias[-1] = 4.0
    for _ in range(ROUNDS):
        z = x.scores(w) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - target) * mass
        w -= RATE * x.gradient(p, n) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK, 0)
    return w, bias


def _gate(weights: dict[str, list[float]], bias: list[float]) -> list[str]:
    """Words, chosen one by one for the most weight, until the n-grams without them can't lift any class over NONE even all together."""
    grams = list(weights)
    margin = np.array([weights[g] for g in grams])
    margin = np.maximum(margin[:, :-1] - margin[:, -1:], 0)
    need = bias[-1] - np.array(bias[:-1])
    words = sorted({w for g in grams for w in g.split()} - COMMON)
    holds = {w: np.array([i for i, g in enumerate(grams) if w in g.split()]) for w in words}
    left, out = np.ones(len(grams), bool), []
    while ((margin * left[:, None]).sum(axis=0) >= 0.99 * need).any():
        over = (margin * left[:, None]).sum(axis=0) >= 0.99 * need
        gain = {w: float(margin[i[left[i]]][:, over].sum()) for w, i in holds.items() if w not in out}
        out.append(max(gain, key=lambda w: (gain[w], w)))
        left[holds[out[-1]]] = False
    return sorted(out)


@lru_cache(maxsize=1)
def train() -> LicenceModel:
    """The model, fitted on all notices. Its temperature is chosen before that by a model that never saw a fourth of the notices of
    each class in any variation, so that it tells how sure to be of notices that are new."""
    rng = np.random.default_rng(SEED)
    notices = templates()
    families = [*sorted(f for f in notices if f != UNKNOWN), UNKNOWN, NONE]
    filler = sorted({w for t in OTHERS for w in re.findall(_WORD, t.lower())})
    texts = [(t, k) for k, f in enumerate(families[:-1]) for t in notices[f]] + [(t, len(families) - 1) for t in OTHERS]
    place: Counter = Counter()
    held = []
    for _, k in texts:
        place[k] += 1
        held.append(place[k] % 4 == 0)
    samples = [(grams_of(_varied(rng, t, filler)), k, h) for (t, k), h in zip(texts, held, strict=True) for _ in range(VARIANTS)]
    seen = Counter(g for grams, _, _ in samples for g in grams)
    index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 4))}
    rows = [[index[g] for g in sorted(grams) if g in index] for grams, _, _ in samples]
    full = [i for i, r in enumerate(rows) if r]
    rows, y, out = [rows[i] for i in full], np.array([samples[i][1] for i in full]), np.array([samples[i][2] for i in full])
    part = lambda keep: _Sparse.of([r for r, own in zip(rows, keep, strict=True) if own])
    w, bias = _fit(part(~out), y[~out], len(index), len(families))
    z, t = part(out).scores(w) + bias, y[out]
    losses = []
    for heat in np.geomspace(0.1, 4, 30):
        s = z / heat
        s = s - s.max(axis=1, keepdims=True)
        losses.append((float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(t)), t])), float(heat)))
    heat = min(losses)[1]
    w, bias = _fit(_Sparse.of(rows), y, len(index), len(families))
    weights = {g: [float(v) for v in w[i] / heat] for g, i in index.items() if np.abs(w[i]).max() > 0}
    biases = [float(v) for v in bias / heat]
    return LicenceModel(families, weights, biases, _gate(weights, biases))


def pairs_of(words: list[str]) -> set[str]:
    """Pairs of neighbouring words (a lone word: itself)."""
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}


def _model_tables(spark: SparkSession, model: LicenceModel) -> tuple[DataFrame, DataFrame]:
    """Weights by n-gram and the word pairs of the templates by class: two tables of fixed size."""
    grams = spark.createDataFrame(sorted(model.weights.items()), "gram string, w array<double>")
    shapes = [(f, sorted(pairs_of(re.findall(_WORD, t.lower())))) for f, texts in sorted(templates().items()) for t in texts]
    return grams, spark.createDataFrame(shapes, "family string, template array<string>")


def _grams_of(words: str, n: int) -> Column:
    """All n-grams of an array of words (a shorter array: itself)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap, confirmed: the paragraphs that the model takes for a licence notice.

    Paragraphs stand between lines without a letter or digit, counted from 0; case and comment marks don't matter. One of more
    than WINDOW words is judged by windows of as many, every STEP words; the likeliest counts for each family, so a paragraph may
    hold several. family: UNKNOWN for notices of no known family. probability: calibrated, of the class; windows under
    LEAST_PROBABILITY, or likelier no notice at all, don't come back. overlap: the largest share of the word pairs of the shorter
    of window and template of that class that both have; confirmed: at least LEAST_OVERLAP and a known family. Null and empty
    texts have no paragraphs; repeated rows count each by itself; a null doc_id stays null; an empty table gives no rows; equal
    probabilities: the first family by name; other columns are ignored. Only the model, of fixed size, is broadcast; only windows
    with a word without which the model can't find anything are scored and shuffled.
    """
    spark = docs.sparkSession
    model = train()
    grams, shapes = _model_tables(spark, model)
    gate = F.array(*[F.lit(w) for w in model.gate])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paragraphs = texts.select("doc_id", F.posexplode(F.split("text", _BLANK, -1)).alias("paragraph", "block"))
    words = paragraphs.select("doc_id", "paragraph", F.xxhash64("block").alias("print"), F.explode(F.array(F.regexp_extract_all(F.lower("block"), F.lit(_WORD), F.lit(0)))).alias("all"))
    words = words.where(F.arrays_overlap("all", gate))
    last = F.greatest(F.ceil((F.size("all") - WINDOW) / STEP), F.lit(0)).cast("int")
    windows = words.select("doc_id", "paragraph", "print", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("all", i * STEP + 1, F.lit(WINDOW)))).alias("at", "words")).where(F.arrays_overlap("words", gate))
    key = ["doc_id", "paragraph", "print", "at", "words"]
    once = windows.groupBy(*key).agg(F.count("*").alias("copies"))
    all_grams = F.array_distinct(F.flatten(F.array(*[_grams_of("words", n) for n in ORDERS])))
    scored = once.select("*", F.explode(all_grams).alias("gram")).join(F.broadcast(grams), "gram")
    sums = scored.groupBy(*key, "copies").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.families))])
    z = F.array(*[F.col(f"s{i}") + F.lit(b) for i, b in enumerate(model.bias)])
    best = sums.select(*key, "copies", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("which", F.array_position("z", F.col("top")))
    names = F.array(*[F.lit(f) for f in model.families])
    chosen = best.select(*key, "copies", F.element_at(names, F.col("which").cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"))
    found = chosen.where((F.col("family") != NONE) & (F.col("probability") >= LEAST_PROBABILITY)).withColumn("pairs", F.array_distinct(_grams_of("words", 2)))
    overlap = F.size(F.array_intersect("pairs", "template")) / F.least(F.size("pairs"), F.size("template"))
    held = found.join(F.broadcast(shapes), "family").groupBy("doc_id", "paragraph", "print", "at", "family", "probability", "copies").agg(F.max(overlap).alias("overlap"))
    top = held.groupBy("doc_id", "paragraph", "print", "family").agg(F.max(F.struct(F.round("probability", 6).alias("p"), F.round("overlap", 6).alias("o"))).alias("best"), F.max("copies").alias("copies"))
    out = top.select("doc_id", "paragraph", "family", F.col("best.p").alias("probability"), F.col("best.o").alias("overlap"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "paragraph", "family", "probability", "overlap", ((F.col("overlap") >= LEAST_OVERLAP) & (F.col("family") != UNKNOWN)).alias("confirmed"))
