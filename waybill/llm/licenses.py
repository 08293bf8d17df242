"""Licence scans: a trained classifier of paragraphs' notices, a calibrated unknown class, and templates that confirm what it says."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import APART, Words, mix, read, text_slices

#: Paragraphs of the corpus that the unknown class is fitted on, at most.
UNKNOWN = 1_500
#: Training variants of each template sentence.
VARIANTS = 14
#: Folds of families that are left out in turn to set the least chance, and the share of their notices that it must refuse.
FOLDS, REFUSED = 4, 0.95
#: Least product of a notice's chance and share before calibration.
LEAST = 0.5
#: Least share of a template's word pairs that a notice must hold, and so many pairs at least.
LEAST_SHARE = 0.6
LEAST_PAIRS = 2
#: Words between two hits that may be no hits within a notice, and words around a notice that are read with it.
GAP, AROUND = 10, 2

#: Usual notices of licence families, a sentence each.
TEMPLATES = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "License: AGPL-3.0",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "License: Apache-2.0",
        "License: Apache 2.0",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
        "License: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "License: BSD-3-Clause",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Distributed under the BSD license.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Released under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
        "License: CC0-1.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Eclipse Public License - v 2.0",
        "License: EPL-2.0",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "Licensed under GPLv2 or later.",
        "License: GPL-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under GPLv3 or later.",
        "License: GPL-3.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "ISC License",
        "License: ISC",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "License: LGPL-2.1",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "MIT License",
        "License: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "License: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "License: Unlicense",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
        "zlib License",
        "License: Zlib",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
#: Sentences with words of licences that are none.
OTHERS = (
    "The driver lost the license after the third offence.",
    "A public licence is required to sell food at the market.",
    "Permission to enter the park is granted free of charge.",
    "Permission is hereby granted to any person to leave the hall free of charge.",
    "The museum is open to the general public, version two of the plan says.",
    "All rights reserved for members of the society are listed here.",
    "The museum was full. All rights reserved seats were gone.",
    "All rights reserved tables had been taken by members.",
    "All seats and rights are reserved for members of the society.",
    "The work is distributed over several software projects.",
    "This file lists the conditions of the roads.",
    "She released the record under her own name in the public square.",
    "The source code of the poem can be found in the file of the library.",
    "The apache helicopter was licensed for flight under version 2 of the rules.",
    "The distribution of food and other materials is provided by the city.",
    "Any later version of the map must retain the list of names.",
)
#: Words that carry no notice by themselves; pairs of them start none.
STOP = "a all an and any are as at be by can for from has in is it its may no not of on or other that the this to under was with you".split()


def _hash(texts: list[str]) -> np.ndarray:
    return np.concatenate([Words(d, o, APART).hashes() for _, _, d, o in text_slices(pa.array(texts, pa.large_string()))] or [np.zeros(0, np.uint64)])


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + mix(h[1:] + np.uint64(5)))


def _in(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    if not len(sorted_):
        return np.zeros(len(values), int), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def notices(column: pa.Array, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a column: (text of each notice, first word, last word + 1, word hashes).

    A notice is a stretch of one paragraph that starts and ends with a seed pair and has one at least every GAP words, with
    AROUND words on either side. Paragraphs end at blank lines and at a text's end, so a wrapped notice is one, and a notice
    inside a long line stands for itself.
    """
    for row, n, data, offsets in text_slices(column):
        words = Words(data, offsets, APART)
        h = words.hashes()
        if len(h) < 2:
            continue
        size = int(offsets[-1])
        lines = np.flatnonzero(data[:size] == 10)
        ink = np.concatenate(([0], np.cumsum(data[:size] > 32)))
        blank = lines[1:][ink[lines[1:]] == ink[lines[:-1] + 1]] if len(lines) > 1 else lines[:0]
        paragraph = np.searchsorted(np.sort(np.concatenate((blank, offsets[1:-1] - 1))), words.starts, "left")
        owner = row + np.repeat(np.arange(n), words.counts)
        hit = np.flatnonzero(_in(seeds, _pairs(h))[1] & (paragraph[:-1] == paragraph[1:]))
        if not len(hit):
            continue
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > GAP) | (paragraph[hit[1:]] != paragraph[hit[:-1]])
        first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] + 2
        low, high = np.searchsorted(paragraph, paragraph[first]), np.searchsorted(paragraph, paragraph[first], "right")
        yield owner[first], np.maximum(first - AROUND, low), np.minimum(last + AROUND, high), h


@dataclass
class Model:
    terms: np.ndarray
    seeds: np.ndarray
    weights: np.ndarray
    families: list[str]
    templates: list[tuple[int, np.ndarray]]
    least: float = LEAST
    refused: float = 0.0

    def chances(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Chance of each family, the unknown first, for stretches of words."""
        row, term, value = _features(self.terms, h, first, last)
        z = np.zeros((len(first), len(self.families)))
        np.add.at(z, row, self.weights[term] * value[:, None])
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def share(self, family: int, h: np.ndarray) -> float:
        """The largest share of one of the family's templates that these words hold."""
        own = np.unique(_pairs(h))
        return max((float(_in(own, t)[1].mean()) for f, t in self.templates if f == family and _in(own, t)[1].sum() >= min(LEAST_PAIRS, len(t))), default=0.0)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, float, float]]:
        """(text, family, chance, share) of each notice that is a licence's: likely enough, and confirmed by a template."""
        for owner, first, last, h in notices(column, self.seeds):
            chance = self.chances(h, first, last)
            best = chance.argmax(1)  # of equal chances the first family
            top = chance[np.arange(len(best)), best]
            for i in np.flatnonzero((best > 0) & (top >= self.least)):
                share = self.share(best[i], h[first[i] : last[i]])
                if share >= LEAST_SHARE and top[i] * share >= self.least:
                    yield int(owner[i]), self.families[best[i]], float(top[i]), share


def _features(terms: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of stretches of words: known words and pairs once each, by the root of the length, and two terms more:
    the share that is not known, and one."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    pair = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
    place, known = _in(terms, np.concatenate((h[at], mix(h[at[pair]] * np.uint64(3) + mix(h[at[pair] + 1] + np.uint64(5))))))
    key = np.unique(np.concatenate((row, row[pair]))[known] * (len(terms) + 2) + place[known])
    r, t = key // (len(terms) + 2), key % (len(terms) + 2)
    total = np.maximum(1, 2 * n - 1)
    strange = 1 - np.minimum(1, np.bincount(r, minlength=len(n)) / total)
    every = np.arange(len(n))
    return (
        np.concatenate((r, every, every)),
        np.concatenate((t, np.full(len(n), len(terms)), np.full(len(n), len(terms) + 1))),
        np.concatenate((1 / np.sqrt(total[r]), strange, np.ones(len(n)))),
    )


def _softmax(row: np.ndarray, term: np.ndarray, value: np.ndarray, y: np.ndarray, d: int, classes: int, rounds: int = 120) -> np.ndarray:
    """Weights (d, classes) of a softmax regression on a sparse matrix; classes weigh the same."""
    by_row, by_term = np.argsort(row, kind="stable"), np.argsort(term, kind="stable")
    rows, terms = np.unique(row[by_row], return_index=True)[1], np.unique(term[by_term], return_index=True)
    share = 1 / np.maximum(1, np.bincount(y, minlength=classes))[y]
    share = (share / share.sum())[:, None]
    goal = np.eye(classes)[y]
    w, mean, spread = np.zeros((3, d, classes))
    for k in range(1, rounds + 1):
        z = np.add.reduceat(w[term[by_row]] * value[by_row, None], rows)
        p = np.exp(z - z.max(1, keepdims=True))
        p = share * (p / p.sum(1, keepdims=True) - goal)
        slope = 1e-5 * w
        slope[terms[0]] += np.add.reduceat(p[row[by_term]] * value[by_term, None], terms[1])
        # steps of like size for rare and common terms
        mean, spread = 0.9 * mean + 0.1 * slope, 0.98 * spread + 0.02 * slope**2
        w -= 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.98**k)) + 1e-8)
    return w


def variants(rng: random.Random, sentence: str, n: int) -> list[str]:
    """The sentence as it stands in files: other case, words lost, wrapped, with words around it."""
    out = [sentence, sentence.lower(), sentence.upper()]
    words = sentence.split()
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.06] or words
        if rng.random() < 0.4:
            w = [*rng.choice((["Copyright", "2020", "The", "Authors."], ["Note:"], ["#"], ["Text"])), *w]
        strange = [f"w{rng.randrange(10**6)}" for _ in range(4)]
        if rng.random() < 0.4:
            w = [*strange[:2], *w]
        if rng.random() < 0.4:
            w = [*w, *strange[2:]]
        elif rng.random() < 0.3:
            w = [*w, *rng.choice(("See the file for details.", "Contact the author.", "2021", "Thank you.")).split()]
        out.append(" ".join(w))
    return out


def fit(unknown: list[str], seed: int = 0) -> Model:
    """A softmax regression on hashed words and word pairs of notices.

    The first class is the unknown: sentences that only sound like licences, and notices found in ``unknown`` paragraphs of
    the corpus that no template confirms. A notice is known by the product of its family's chance and the share of a template
    that it holds: chances alone are low where families share their wording, shares alone high. The least product is set on
    families that training has not seen: in FOLDS rounds a part of the families is left out, and their notices, which should
    stay unknown, are scored; the least one that refuses REFUSED of them is taken, from LEAST up. ``refused`` is the share
    that it does refuse.
    """
    rng = random.Random(seed)
    families = ["unknown", *sorted(TEMPLATES)]
    plain = [(k, s) for k, f in enumerate(families) for s in (TEMPLATES[f] if k else ())]
    hashed = [(k, _hash([s])) for k, s in plain]
    terms = np.unique(np.concatenate([np.concatenate((h, _pairs(h))) for h in [*(h for _, h in hashed), *(_hash([s]) for s in OTHERS)]]))
    stop = np.sort(_hash([" ".join(STOP)]))
    rare = [_pairs(h)[~(_in(stop, h[:-1])[1] & _in(stop, h[1:])[1])] for _, h in hashed]
    model = Model(terms, np.unique(np.concatenate(rare)), np.zeros((len(terms) + 2, len(families))), families, [(k, np.unique(_pairs(h))) for k, h in hashed])
    said = [(k, text) for k, sentence in [*plain, *((0, s) for s in OTHERS)] for text in variants(rng, sentence, VARIANTS)]
    rows, y = [], []
    for owner, first, last, h in notices(pa.array([text for _, text in said]), model.seeds):
        for i, a, b in zip(owner, first, last):
            rows.append(h[a:b])
            y.append(said[i][0])
    for _, first, last, h in notices(pa.array(unknown, pa.large_string()), model.seeds):
        for a, b in zip(first, last):
            if max(model.share(k, h[a:b]) for k in range(1, len(families))) < LEAST_SHARE:
                rows.append(h[a:b])
                y.append(0)
    label = np.array(y)
    ends = np.cumsum([len(r) for r in rows])
    sparse = _features(terms, np.concatenate(rows), ends - [len(r) for r in rows], ends)
    d, classes = len(terms) + 2, len(families)

    def trained(use: np.ndarray) -> np.ndarray:
        place = np.cumsum(use) - 1
        own = use[sparse[0]]
        return _softmax(place[sparse[0][own]], sparse[1][own], sparse[2][own], label[use], d, classes)

    strangers = []
    for fold in range(FOLDS):
        out = (label > 0) & (label % FOLDS == fold)
        w = trained(~out)
        z = np.zeros((len(label), classes))
        np.add.at(z, sparse[0], w[sparse[1]] * sparse[2][:, None])
        z[:, [k for k in range(1, classes) if k % FOLDS == fold]] = -1e9  # what training has not seen has no weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i in np.flatnonzero(out):
            best = p[i].argmax()
            share = model.share(best, rows[i]) if best > 0 else 0.0
            strangers.append(p[i, best] * share if share >= LEAST_SHARE else 0.0)
    model.weights = trained(np.ones(len(label), bool))
    model.least = max(LEAST, float(np.quantile(strangers, REFUSED)) + 1e-9)
    model.refused = float((np.array(strangers) < model.least).mean())
    return model


def train(docs: DataFrame, most: int = UNKNOWN) -> Model:
    """A model whose unknown class has seen one paragraph each of at most ``most`` documents, those with the smallest digests.

    Keys are ordered alone; the texts of those chosen are fetched by a broadcast of the keys and cut to a paragraph where they are.
    """
    keys = docs.where("doc_id is not null").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("at")).distinct().orderBy("at", "doc_id").limit(most)
    paragraph = F.expr("try_element_at(filter(split(text, '\\n'), p -> length(p) > 20 and length(p) < 1000), 1)")
    rows = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id", "left_semi").select(paragraph.alias("p")).where("p is not null").distinct().orderBy("p").collect()
    return fit([r.p for r in rows])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and n_licences (notices), licences (families, sorted, comma-joined), chance, share.

    ``chance`` and ``share`` (of a template, that the notice holds) are those of the likeliest notice, or 0; of equal ones
    the first. Whole texts are read; notices of a paragraph with few words between them are one. Null and
    empty texts have none; repeated rows each get their result; columns named like a result are replaced; an empty table
    gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    result = ["n_licences", "licences", "chance", "share"]
    kept = [c for c in docs.columns if c not in result]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            names: dict[int, set[str]] = {}
            chance, share = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, family, c, s in known.value.scan(batch.column(at)):
                n[i] += 1
                names.setdefault(i, set()).add(family)
                if c > chance[i]:
                    chance[i], share[i] = c, s
            joined = [",".join(sorted(names.get(i, ()))) for i in range(batch.num_rows)]
            yield pa.record_batch([*batch.columns, pa.array(n), pa.array(joined, pa.string()), pa.array(chance), pa.array(share)], names=[*kept, *result])

    own = docs.select(*kept)
    kinds = [T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *[T.StructField(c, k) for c, k in zip(result, kinds, strict=True)]]))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs)).drop("text")
