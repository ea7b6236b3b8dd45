"""License scans: a trained paragraph classifier of licence families, confirmed against templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Sentences that share words with licences and are none.
NEGATIVE = (
    "He lost his driving license in the city and had to walk home under the rain.",
    "The general public was permitted to use the library free of charge.",
    "Version 2.0 of the plan was released in the following year without any notice.",
    "She has the right to copy the work, the author said in writing.",
    "A copy of the software was distributed to all members of the team.",
    "The terms of the agreement are subject to the law of the land.",
    "Copyright law is taught in the third year.",
    "They work under the same conditions as all persons in the public service.",
)
UNKNOWN = "unknown"

#: Rows of features.
SLOTS = 1 << 14
NGRAMS = (1, 2, 3)
#: Lines of the corpus that serve as examples of no licence in training, at most, and the longest that is taken.
BACKGROUND_LINES, LONGEST_LINE = 800, 2000
#: A longer sentence is cut into units of so many words.
UNIT_WORDS = 24
#: Share of a prediction's template word pairs that a paragraph must have, or of its own that the template must have.
CONFIRM = 0.5
SEED = 3


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(["", *words], [*words, ""], strict=True))


def features(text: str) -> dict[int, float]:
    """Slots of the word n-grams of a paragraph, their counts damped and the whole of length 1."""
    words = words_of(text)
    counts = Counter(xxhash.xxh32_intdigest(" ".join(words[i : i + n])) % SLOTS for n in NGRAMS for i in range(len(words) - n + 1))
    out = {k: 1 + np.log(v) for k, v in counts.items()}
    norm = np.sqrt(sum(v * v for v in out.values())) or 1.0
    return {k: v / norm for k, v in out.items()}


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    weights: np.ndarray  # SLOTS x families
    bias: np.ndarray
    temperature: float
    floor: float  # probabilities of a family below it are UNKNOWN
    held_accuracy: float  # on variants of templates, and on negatives, that the calibrating fit never saw

    def probabilities(self, text: str) -> np.ndarray:
        f = features(text)
        z = (self.bias + (self.weights[list(f)] * np.array(list(f.values()))[:, None]).sum(0)) / self.temperature if f else self.bias / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        p = self.probabilities(text)
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= self.floor else (UNKNOWN, float(p[-1]))


def _examples(background: list[str], rng: np.random.Generator) -> list[tuple[str, str, bool]]:
    """(text, family, held): templates and variants of them (words lost, swapped and added, parts of long ones), and what is no licence.

    Of each family with three templates or more, one template is held with all its variants; so are a quarter of the negatives and a fifth of the background.
    """
    filler = [w for line in background for w in line.split()[:20]] or ["lorem"]
    out = []
    for family, texts in TEMPLATES.items():
        kept_out = int(rng.integers(0, len(texts))) if len(texts) > 2 else -1
        for k, text in enumerate(texts):
            own = [text] * 3
            words = text.split()
            for _ in range(12):
                kept = [w for w in words if rng.random() > 0.1] or words
                if len(words) > 16 and rng.random() < 0.4:
                    at = int(rng.integers(0, len(kept) // 2))
                    kept = kept[at : at + max(8, len(kept) // 2)]
                if len(words) > 6 and rng.random() < 0.7:
                    at = int(rng.integers(0, len(kept) + 1))
                    kept = kept[:at] + [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(1, 1 + max(1, len(words) // 4))))] + kept[at:]
                own.append(" ".join(kept))
            out += [(x, family, k == kept_out) for x in own]
    out += [(t, UNKNOWN, k % 4 == 3) for k, t in enumerate(NEGATIVE) for _ in range(8)]
    out += [(line, UNKNOWN, k % 5 == 4) for k, line in enumerate(background)]
    # single words of licences amid other words are none
    single = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
    out += [(" ".join([*(filler[int(i)] for i in rng.integers(0, len(filler), 8)), single[int(rng.integers(0, len(single)))]]), UNKNOWN, k % 5 == 4) for k in range(400)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(gram: np.ndarray, y: np.ndarray, n_families: int, use: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the examples, bias): full-batch gradient steps of multinomial logistic regression from zero weights.

    The weights stay combinations of the examples' features, so the steps go over those coefficients and the table of inner products.
    """
    weight = np.where(use, (1.0 / np.maximum(1, np.bincount(y[use], minlength=n_families)))[y], 0.0)
    weight /= weight.sum()
    a, b, onehot = np.zeros((len(y), n_families), np.float32), np.zeros(n_families), np.eye(n_families)[y]
    for _ in range(steps):
        g = ((_softmax(gram @ a + b) - onehot) * weight[:, None]).astype(np.float32)
        a -= rate * n_families * (g + decay * a)
        b -= rate * g.sum(0)
    return a, b


def train(background: list[str], steps: int = 200, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Sparse word n-grams into a multinomial logistic regression.

    Temperature and floor come from a first fit without the held templates, negatives and background; the model is then fitted on all examples.
    """
    rng = np.random.default_rng(SEED)
    examples = _examples(background, rng)
    families = [*TEMPLATES, UNKNOWN]
    rows = [features(t) for t, _, _ in examples]
    y = np.array([families.index(f) for _, f, _ in examples])
    held = np.array([h for _, _, h in examples])
    used = np.unique([k for f in rows for k in f])
    column = {int(k): i for i, k in enumerate(used)}
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, f in enumerate(rows):
        x[i, [column[k] for k in f]] = list(f.values())
    gram = x @ x.T
    a, b = _fit(gram, y, len(families), ~held, steps, rate, decay)
    z, want = (gram @ a + b)[held], y[held]

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), want], 1e-12)).mean())

    temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
    p = _softmax(z / temperature)
    unknown = len(families) - 1
    wrong = p[(want == unknown) & (p.argmax(1) < unknown)].max(1, initial=0.5)
    floor = float(min(0.9, max(0.5, wrong.max(initial=0.5) + 0.01)))
    said = np.where(p.max(1) >= floor, p.argmax(1), unknown)
    a, b = _fit(gram, y, len(families), np.ones(len(y), bool), steps, rate, decay)
    weights = np.zeros((SLOTS, len(families)), np.float32)
    weights[used] = x.T @ a
    return Model(families, weights, b, temperature, floor, float((said == want).mean()))


_TEMPLATE_PAIRS = {family: [_pairs(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}
#: Which templates have a pair of words, by their numbers over all families.
_HOLDERS: dict[tuple[str, str], list[int]] = {}
for _k, _t in enumerate(t for sets in _TEMPLATE_PAIRS.values() for t in sets):
    for _p in _t:
        _HOLDERS.setdefault(_p, []).append(_k)
_TEMPLATE_WORDS = {w for p in _HOLDERS for w in p if w}
_SENTENCE = re.compile(r"(?<=[.!?:;])\s+")


def confirmed(text: str, family: str) -> float:
    """How well a template of the family covers the paragraph, or the paragraph the template: the best share of word pairs."""
    own = _pairs(words_of(text))
    return max((len(own & t) / min(len(own), len(t)) if len(own & t) > 1 else 0.0 for t in _TEMPLATE_PAIRS.get(family, [])), default=0.0)


def scan_paragraph(model: Model, text: str) -> tuple[str, float, float] | None:
    """(family, probability, template share) of a confirmed licence paragraph, else None."""
    words = words_of(text)
    if sum(p in _HOLDERS for p in _pairs(words)) < 2:
        return None  # no template could confirm a prediction
    family, p = model.predict(text)
    if family == UNKNOWN:
        return None
    share = confirmed(text, family)
    return (family, p, share) if share >= CONFIRM else None


def units_of(line: str) -> list[list[str]]:
    """The words of each sentence of a line; long sentences in parts."""
    out = []
    for sentence in _SENTENCE.split(line):
        words = words_of(sentence)
        out += [words[i : i + UNIT_WORDS] for i in range(0, len(words), UNIT_WORDS)]
    return out


def paragraphs(units: list[list[str]]) -> list[tuple[int, int]]:
    """(first, behind the last) of the runs of units that are judged as one.

    A run is worth the word pairs that it shares with its best template, less one, and the runs are those that are worth most together: the lines of a wrapped notice,
    which share the pairs across their ends as well, become one, and notices of two licences beside each other stay two. A run grows as long as that
    gains pairs, with one unit in between that doesn't.
    """
    n = len(units)
    best, back = [0] * (n + 1), list(range(-1, n))
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], i
        seen: set[tuple[str, str]] = set()
        hits: Counter = Counter()
        before, top, idle = "", 0, 0
        for j in range(i, n):
            for w in units[j]:
                pair = (before, w)
                if pair not in seen:
                    seen.add(pair)
                    for k in _HOLDERS.get(pair, ()):
                        hits[k] += 1
                before = w
            ends = _HOLDERS.get((before, ""), ())
            value = max((v + (k in ends) for k, v in hits.items()), default=0)
            idle = 0 if value > top else idle + 1
            top = max(top, value)
            worth = best[i] + max(0, value - 1)
            if worth > best[j + 1] or (worth == best[j + 1] and j == i):
                best[j + 1], back[j + 1] = worth, i
            if idle > 1:
                break
    out, at = [], n
    while at > 0:
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def scan_text(model: Model, text: str, known: dict[str, bool] | None = None) -> tuple[int, list[dict]]:
    """(lines with a word, findings) of a text. known: if short lines met before may belong to a notice."""
    found: list[dict] = []
    n, run = 0, []  # (line, unit) of lines next to each other that share pairs with a template
    known = {} if known is None else known

    def settle() -> None:
        for a, b in paragraphs([u for _, u in run]):
            got = scan_paragraph(model, " ".join(w for _, u in run[a:b] for w in u))
            if got:
                found.append({"line": run[a][0], "lines": run[b - 1][0] - run[a][0] + 1, "family": got[0], "probability": got[1], "share": got[2]})
        run.clear()

    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        n += 1
        may = known.get(line)
        if may is None:
            words = words_of(line)
            may = sum(p in _HOLDERS for p in _pairs(words)) > 1 or (0 < len(words) < 4 and not _TEMPLATE_WORDS.isdisjoint(words))
            if len(line) < 400:
                if len(known) > 50_000:
                    known.clear()
                known[line] = may
        if may:
            run += [(i, u) for u in units_of(line)]
        elif run:
            settle()
    if run:
        settle()
    return n, found


def background_lines(docs: DataFrame, text_col: str = "text", lines: int = BACKGROUND_LINES) -> list[str]:
    """At most `lines` lines without any licence word, one of each of the documents of least hash: a bounded sample of what is no licence.

    A document's line is the one of least hash among those of 20 to LONGEST_LINE characters. Documents whose hash lies above the share that about four times as many would need
    are left out first, so that not every task sends `lines` rows to the driver.
    """
    share = min(1.0, 4 * lines / max(1, docs.count()))
    text = F.col(text_col).cast("string")
    low = F.xxhash64("text").cast("double") <= -(2.0**63) + share * 2.0**64
    plain = F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 20) & (F.length(x) <= LONGEST_LINE) & ~F.lower(x).rlike("licen[sc]e|copyright|warrant|rights reserved|spdx"))
    rows = docs.select(text.alias("text")).where(low).select(F.array_min(F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line"))))["line"].alias("line")).where("line is not null")
    return [r[0] for r in rows.orderBy(F.xxhash64("line"), "line").limit(lines).collect()]


_models: dict[str, Model] = {}


def trained(background: list[str]) -> Model:
    """The model for a sample of lines, trained once in a process."""
    key = xxhash.xxh3_128_hexdigest("\n".join(background))
    if key not in _models:
        _models.clear()
        _models[key] = train(background)
    return _models[key]


def license_scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, families array, findings array<struct<line, lines, family, probability, share>>) for each row.

    n_paragraphs counts the lines with a word. What is judged are runs of sentences, over line ends where a notice is wrapped, and within a long line where a notice stands
    amid other text (see paragraphs()); only lines that share no two word pairs with any template, which could confirm nothing, are left out. families are the distinct ones found, sorted; findings are in text order, line
    counted from 0. Null and empty texts have no findings; repeated rows are scanned each; null ids stay null, other columns don't
    matter. The model is trained here on templates and a bounded sample of lines unless one is given. Nothing is shuffled
    but that sample. A long line takes memory in proportion to its length, at any length.
    """
    model = model or trained(background_lines(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x families floats, whatever docs holds
    finding = pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, bool] = {}
        for batch in batches:
            counts, families, findings = [], [], []
            for text in batch.column(1):
                n, found = scan_text(own, text.as_py() or "", known)
                counts.append(n)
                findings.append(found)
                families.append(sorted({f["family"] for f in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(families, pa.list_(pa.string())), pa.array(findings, pa.list_(finding))], names=["doc_id", "n_paragraphs", "families", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, families array<string>, findings array<struct<line: int, lines: int, family: string, probability: double, share: double>>")
