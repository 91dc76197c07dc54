"""Licence scans: an n-gram logistic regression over paragraphs, a calibrated unknown class and template comparison."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import hash_words, mix, pick, text_bytes

# Names of the licence families, how notices introduce them, and passages of the public licence texts.
NAMES = {
    "agpl": ("GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL v3"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"),
    "bsd": ("BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "New BSD License", "BSD license"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"),
    "cc0": ("CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0", "CC0 public domain dedication"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0", "GPL-2.0-or-later", "GNU GPL v3"),
    "lgpl": ("GNU Lesser General Public License, version 3", "LGPL-2.1", "GNU LGPL v3"),
    "mit": ("MIT License", "Expat License", "MIT"),
    "mpl": ("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License, v. 2.0"),
    "proprietary": ("proprietary commercial license", "end user license agreement", "All Rights Reserved terms"),
}
FRAMES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This project is available under the {}, see LICENSE.", "SPDX-License-Identifier: {}", "License: {}")
PASSAGES = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by": ("You are free to share and adapt the material for any purpose, even commercially, provided you give appropriate credit, under a Creative Commons Attribution license.",),
    "cc-by-nc": ("You may not use the material for commercial purposes; licensed under a Creative Commons Attribution-NonCommercial license.",),
    "cc-by-sa": ("If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons ShareAlike license as the original.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicates it to the public domain.",),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",),
}
#: Paragraphs that speak of licences, permissions or terms without any of the families.
NOT_FAMILIES = (
    "Licensed under the Orion Community License, version 7.", "Released under the house rules of the club.", "Distributed under the Willow Sharing Terms 1.2.", "This work is licensed to the city library for one year.",
    "The driving licence was issued in May and renewed under the new rules.", "She asked for permission to enter the building, free of charge.", "The general public may visit the museum, and the software is provided in the hall.",
    "See the terms of service for details of the warranty and of your rights.", "Source code and binary forms of the puzzle are printed on the back.", "Version 2.0 of the manual was released under the supervision of the editor.",
    "A fishing license is required by law in this county.", "The foundation published a version of the report for the public domain of the arts.", "The commons are open to all; creative people meet there.", "An international licence fee applies to commercial radio.",
)

#: A paragraph is a line, or a run of lines; a longer one is judged in overlapping windows of so many words.
WINDOW, STRIDE = 60, 30
UNKNOWN = "unknown"
FAMILIES = tuple(sorted(NAMES))
CLASSES = (*FAMILIES, UNKNOWN)
#: Lower-cases A-Z and turns ASCII characters that are neither letters, digits nor line breaks into spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in range(256))
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def notices() -> dict[str, list[str]]:
    """Reference notices of each family: its passages, and its names in every frame."""
    return {f: [*PASSAGES[f], *(frame.format(name) for name in NAMES[f] for frame in FRAMES)] for f in FAMILIES}


def paragraphs(text: bytes, wrapped: bool = False) -> list[list[bytes]]:
    """Words of each line; ``wrapped`` adds those of the next lines, up to one without words, to the first of a run."""
    out = [line.split() for line in text.translate(_PLAIN).split(b"\n")]
    first = None
    for i, words in enumerate(out if wrapped else []):
        if words and first is not None:
            first += words
            out[i] = []
        else:
            first = words or None
    return out


@dataclass
class Units:
    """Windows of the lines of some texts, and the n-gram hashes that start at each word of all lines."""

    owner: np.ndarray
    line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    grams: tuple[np.ndarray, np.ndarray, np.ndarray]
    inside: tuple[np.ndarray, np.ndarray]


def units(texts: list[bytes | None], wrapped: bool = False) -> Units:
    words: list[bytes] = []
    owner, number, lengths = [], [], []
    for k, text in enumerate(texts):
        for i, line in enumerate(paragraphs(text or b"", wrapped)):
            if line:
                words += line
                owner.append(k)
                number.append(i)
                lengths.append(len(line))
    n = np.array(lengths, np.int64)
    first = np.cumsum(n) - n
    h = hash_words(words)
    where = np.repeat(np.arange(len(n)), n)
    same2 = np.r_[where[1:] == where[:-1], [False]][: len(h)]
    same3 = np.r_[where[2:] == where[:-2], [False, False]][: len(h)] if len(h) > 1 else np.zeros(len(h), bool)
    one, two = np.r_[h[1:], h[:1]], np.r_[h[2:], h[:2]]
    grams = (h, mix(h * _SALTS[0] + one), mix(h * _SALTS[1] + one * _SALTS[2] + two))
    windows = np.maximum(1, np.ceil((n - WINDOW) / STRIDE).astype(np.int64) + 1)
    rows = np.repeat(np.arange(len(n)), windows)
    step = (np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    start = first[rows] + step
    end = np.minimum(start + WINDOW, first[rows] + n[rows])
    return Units(np.array(owner, np.int64)[rows], np.array(number, np.int64)[rows], start, end, step, grams, (same2, same3))


@dataclass
class LicenseModel:
    """Sorted hashes of the n-grams that carry weight, their weights, intercepts and the calibration's temperature."""

    vocabulary: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset[int]]]

    def hits(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """Word positions, in order, and vocabulary places of the n-grams that carry weight."""
        at, place = [], []
        for g, ok in zip(u.grams, (None, *u.inside), strict=True):
            i = np.searchsorted(self.vocabulary, g)
            i[i == len(self.vocabulary)] = 0
            good = self.vocabulary[i] == g
            if ok is not None:
                good &= ok
            p = np.flatnonzero(good)
            at.append(p)
            place.append(i[p])
        at, place = np.concatenate(at), np.concatenate(place)
        order = np.argsort(at, kind="stable")
        return at[order], place[order]

    def logits(self, u: Units) -> np.ndarray:
        at, place = self.hits(u)
        total = np.zeros((len(at) + 1, self.weights.shape[1]))
        np.cumsum(self.weights[place], axis=0, out=total[1:])
        low, high = np.searchsorted(at, u.start), np.searchsorted(at, u.end)
        return (total[high] - total[low]) / np.sqrt(np.maximum(high - low, 8))[:, None] + self.intercepts

    def probabilities(self, u: Units) -> np.ndarray:
        z = self.logits(u) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def similarity(self, u: Units, k: int, family: str) -> float:
        """Share of common word pairs, of the smaller side, with the family's nearest reference notice."""
        return similarity(pair_set(u, k), self.templates[family])


def pair_set(u: Units, k: int) -> frozenset[int]:
    a, b = int(u.start[k]), int(u.end[k])
    return frozenset(u.grams[1][a : b - 1].tolist())


def similarity(pairs: frozenset[int], templates: list[frozenset[int]]) -> float:
    return max((len(pairs & t) / min(len(pairs), len(t)) for t in templates), default=0.0) if pairs else 0.0


def _examples(filler: list[list[str]], seed: int, copies: int) -> list[tuple[str, str]]:
    """(paragraph, class): each family's notices whole, in parts, with lost words and among other words."""
    rng, out = random.Random(seed), []

    def around(words: list[str]) -> str:
        rest = rng.choice(filler) if filler else []
        at, n = rng.randrange(len(rest) + 1), rng.randrange(3, 40)
        return " ".join([*rest[max(0, at - n) : at], *words, *rest[at : at + n]])

    for family, texts in notices().items():
        for text in texts:
            words = text.split()
            out.append((text, family))
            for _ in range(copies):
                some = [w for w in words if rng.random() > 0.08] or words
                if len(some) > 16:
                    a = rng.randrange(len(some) - 12)
                    some = some[a : a + rng.randrange(12, len(some) - a + 1)]
                out.append((around(some) if rng.random() < 0.5 else " ".join(some), family))
    for text in NOT_FAMILIES:
        out.append((text, UNKNOWN))
        out += [(around(text.split()), UNKNOWN) for _ in range(2 * copies)]
    return out


def _filler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the paragraphs of whole texts, in order."""
    for batch in batches:
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), text_bytes(batch.column("text")), strict=True):
            p = [b" ".join(w[i : i + WINDOW]).decode("utf-8", "replace") for w in paragraphs(text or b"") for i in range(0, max(1, len(w) - STRIDE), STRIDE)]
            n = len(p)
            yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(p, pa.string())], names=["a", "b", "i", "p"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 300, sample_paragraphs: int = 3000, copies: int = 3, vocabulary: int = 4096, ridge: float = 1e-4, rounds: int = 300, seed: int = 7) -> LicenseModel:
    """Trains on reference notices and, as the unknown class, on paragraphs of at most ``sample_rows`` documents.

    The documents are those of lowest id hash, and at most ``sample_paragraphs`` windows of their paragraphs are taken, from
    the first fifty times as many, so texts of any length send no more; those that resemble a notice are left out. A fifth of all examples sets the temperature that calibrates probabilities.
    """
    d = pick(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("a", F.xxhash64("doc_id")).withColumn("b", F.xxhash64("text"))
    chosen = d.select("a", "b").distinct().orderBy("a", "b").limit(sample_rows)  # hashes first, so that tasks send no texts
    sample = d.join(F.broadcast(chosen), ["a", "b"]).dropDuplicates(["a", "b"]).orderBy("a", "b")  # sample_rows pairs
    some = sample.mapInArrow(_filler, "a long, b long, i int, p string").orderBy("a", "b", "i").limit(50 * sample_paragraphs)
    other = [r["p"] for r in some.collect()]  # windows of sixty words at most
    random.Random(seed).shuffle(other)
    other = [p for p in other if p][:sample_paragraphs]
    templates = {f: [pair_set(u, k) for u in [units([t.encode() for t in ts])] for k in range(len(u.start))] for f, ts in notices().items()}
    every = [t for ts in templates.values() for t in ts]
    u = units([p.encode() for p in other])
    resembles = {int(u.owner[k]) for k in range(len(u.start)) if similarity(pair_set(u, k), every) >= 0.4}
    other = [p for i, p in enumerate(other) if i not in resembles]
    rows = _examples([p.split() for p in other if len(p.split()) > 8], seed, copies) + [(p, UNKNOWN) for p in other]
    random.Random(seed + 1).shuffle(rows)

    u = units([p.encode().replace(b"\n", b" ") for p, _ in rows])
    first = np.flatnonzero(np.r_[True, u.owner[1:] != u.owner[:-1]])  # the first window of each example
    keep = u.owner[first]
    label = np.array([CLASSES.index(rows[i][1]) for i in keep])
    seen: Counter = Counter()
    each = []
    for k in first:
        a, b = int(u.start[k]), int(u.end[k])
        grams = [g for gs, ok in zip(u.grams, (None, *u.inside), strict=True) for g in (gs[a:b] if ok is None else gs[a:b][ok[a:b]]).tolist()]
        each.append(grams)
        if label[len(each) - 1] != CLASSES.index(UNKNOWN) or rows[keep[len(each) - 1]][0] in NOT_FAMILIES:
            seen.update(set(grams))
    chosen = np.sort(np.array([g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]], np.uint64))
    x = np.zeros((len(each), len(chosen)), np.float32)
    for i, grams in enumerate(each):
        g = np.array(grams, np.uint64)
        p = np.minimum(np.searchsorted(chosen, g), len(chosen) - 1)
        np.add.at(x[i], p[chosen[p] == g], 1)
        x[i] /= math.sqrt(max(8.0, float(x[i].sum())))
    held = np.arange(len(label)) % 5 == 4
    w, b = _softmax_regression(x[~held], label[~held], len(CLASSES), ridge, rounds)
    return LicenseModel(chosen, w.astype(np.float64), b.astype(np.float64), _temperature(x[held] @ w + b, label[held]), templates)


def _softmax_regression(x: np.ndarray, y: np.ndarray, k: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch accelerated gradient descent; every class counts by the square root of its size."""
    size = np.bincount(y, minlength=k)
    each = (1 / np.sqrt(np.maximum(size, 1)))[y].astype(np.float32)
    each /= each.sum()
    goal = np.eye(k, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    vw, vb = w.copy(), b.copy()
    rate = np.float32(1.0 / (0.5 * float((each[:, None] * x**2).sum(1).max() * len(x) / 4 + 1) + ridge))
    rate = max(rate, np.float32(4.0))
    for t in range(rounds):
        z = x @ vw + vb
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - goal) * each[:, None]
        nw, nb = vw - rate * (x.T @ p + ridge * vw), vb - rate * p.sum(0)
        m = np.float32(t / (t + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, from a grid, with the least log loss on held-out examples."""
    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return min((2.0 ** (k / 4) for k in range(-8, 13)), key=loss) if len(y) else 1.0


HIT = "line int, start int, end int, family string, probability double, similarity double, confirmed boolean"
#: Bytes of text that are handled at once.
STEP_BYTES = 2_000_000


#: Families whose notices hold the words of another's, by that other.
WIDER = {"gpl": ("lgpl", "agpl"), "cc-by": ("cc-by-nc", "cc-by-sa")}


def _judged(model: LicenseModel, u: Units, n: int, least_probability: float, least_similarity: float) -> list[list[tuple[int, int, dict]]]:
    """(first word, end, hit) of each of ``n`` texts. Of windows of one unit that overlap and agree, the likeliest stands."""
    out: list[list[tuple[int, int, dict]]] = [[] for _ in range(n)]
    if not len(u.start):
        return out
    p = model.probabilities(u)
    best = p[:, :-1].argmax(1)
    for k in np.flatnonzero(p[np.arange(len(best)), best] >= least_probability):
        family, likely = FAMILIES[best[k]], float(p[k, best[k]])
        s = model.similarity(u, k, family)
        hit = {"line": int(u.line[k]), "start": int(u.offset[k]), "end": int(u.offset[k] + u.end[k] - u.start[k]), "family": family, "probability": likely, "similarity": s, "confirmed": s >= least_similarity}
        into, found_ = out[int(u.owner[k])], (int(u.start[k]), int(u.end[k]), hit)
        last = into[-1][2] if into else None
        if last and last["line"] == hit["line"] and last["family"] == family and hit["start"] < last["end"]:
            if (hit["confirmed"], likely) > (last["confirmed"], last["probability"]):
                into[-1] = found_
        else:
            into.append(found_)
    return out


def found(model: LicenseModel, texts: list[bytes | None], least_probability: float, least_similarity: float) -> list[list[dict]]:
    """The licence paragraphs of each text: its lines, and windows over the breaks of consecutive lines.

    A window over breaks adds a hit where a reference notice shares more word pairs with it than with any one line in it.
    It takes the place of hits of those lines that were only a part of it ('General Public License' after 'GNU Lesser').
    """
    u = units(texts)
    lines = _judged(model, u, len(texts), least_probability, least_similarity)
    over = _judged(model, units(texts, wrapped=True), len(texts), least_probability, least_similarity)  # words are at the same places
    out = []
    for own, more in zip(lines, over, strict=True):
        added, gone = [], set()
        for a, b, hit in more:
            shared = lambda c, d, f=hit["family"]: max(len(t & frozenset(u.grams[1][c : d - 1].tolist())) for t in model.templates[f])
            parts = range(np.searchsorted(u.start, a - WINDOW), np.searchsorted(u.start, b))
            if not hit["confirmed"] or shared(a, b) <= max(shared(max(a, int(u.start[k])), min(b, int(u.end[k]))) for k in parts if u.end[k] > a):
                continue
            gone |= {k for k, (c, d, h) in enumerate(own) if c < b and a < d and (h["family"] == hit["family"] or hit["family"] in WIDER.get(h["family"], ()))}
            added.append((a, b, hit))
        out.append([h for *_, h in sorted([x for k, x in enumerate(own) if k not in gone] + added, key=lambda x: x[:2])])
    return out


def scan(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text", least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """``doc_id, n_paragraphs, hits`` of each row, over every paragraph of the whole text.

    A hit is a line or a run of lines (or a window of a long one, in words), named by its first line, whose family is more probable than ``least_probability``;
    ``confirmed`` says that a reference notice of the family shares enough word pairs with it. Everything else is of
    the unknown class. ``n_paragraphs`` counts lines. A null or empty text has none; ids may be null or repeat, each row is judged alone.
    """
    kind = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``vocabulary`` rows of weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            hits: list[list[dict]] = []
            some: list[bytes | None] = []
            size = 0
            for text in texts:
                some.append(text)
                size += len(text or b"")
                if size >= STEP_BYTES:
                    hits += found(shared.value, some, least_probability, least_similarity)
                    some, size = [], 0
            hits += found(shared.value, some, least_probability, least_similarity)
            n = [sum(bool(line.strip()) for line in (t or b"").split(b"\n")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_paragraphs", "hits"])

    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, f"doc_id long, n_paragraphs long, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
