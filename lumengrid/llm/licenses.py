"""Licence scans with a trained paragraph classifier.

A text's lines, and the overlapping stretches of 40 words of longer lines, are paragraphs. A multinomial logistic
regression over the presence of word 1- to 3-grams, held sparsely as hashes, tells licence families from unknown; it is
trained in numpy from the notices below, varied by cutting, dropping and replacing words, and from all paragraphs of the
corpus and everyday sentences that speak of licences as the unknown class. Its log odds of any licence are calibrated
to a probability on varied notices and unknown paragraphs kept out of training, and that is held against a threshold set
on the same unknown paragraphs. A predicted family is confirmed by comparing the paragraph with the family's notices: the
shared share of word bigrams.

Every paragraph of every text goes through the classifier, blocks of paragraphs at a time.

Defined results: null, empty and word-less texts have no licences; texts are read whole; repeated rows are scanned alike;
without any text the unknown class is the everyday sentences alone. Outputs come as one column, so other columns keep
their names; ids are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, WordHashes, released, sliced, stored, struct_array

STRETCH = 40
#: Paragraphs that are classified at once.
BLOCK = 2048
#: The shared share of bigrams that confirms a family.
CONFIRMED = 0.5
#: One distinct paragraph in so many, by hash, is kept out of training for calibration and threshold.
HELD_OUT = 5
#: Paragraphs kept out of training, about, where the model is fitted on a draw.
HELD_ROWS = 4500
#: Different views of paragraphs that the driver fits with at most; more stay on the executors, which add up each step.
NEAR_ROWS = 200_000
#: Step to which log odds of paragraphs are rounded there, for calibration and threshold.
MARGIN = 1e-4
#: The share of unknown paragraphs that may pass the threshold.
FALSE_ALARMS = 0.001
UNKNOWN = "unknown"
SPEAKS = re.compile(rb"licen|copyright")

#: Notices by family.
NOTICES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0.", "This work is licensed under the Apache License, version 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU General Public License for more details."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License."],
    "proprietary": ["Copyright. All rights reserved.", "This material is proprietary and confidential. Unauthorized copying is strictly prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}

#: Sentences that speak of such things and grant nothing.
EVERYDAY = ["You need a valid driving license to rent a car.", "The software was released last week and is useful.", "The public library is open to any person.", "Permission to park is granted by the city.", "He was licensed as a pilot in the general aviation program.", "The terms of the agreement were published by the foundation.", "A copy of the file can be found in the source folder.", "The warranty of the product covers two years.", "The Apache are a group of tribes of the southwest.", "She studied at MIT and wrote about free speech.", "The version of the document was modified without notice.", "The work of the author is in the public domain of debate.", "The commons debated the bill and the general public watched.", "Use the form in the following cases and obtain a copy of the conditions."]

#: Words that say nothing by themselves, a number among them.
PLAIN = frozenset(b"0 a an and any are as at be by can for has he her his i in is it its may no not of on or she that the this to was were will with you your we they from but all do if so".split())
_KEEP_LINES = bytes(10 if b == 10 else c for b, c in enumerate(WORD_TABLE))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(text: str | None) -> Iterator[list[bytes]]:
    """Word lists of the lines of a text, long lines in overlapping stretches."""
    if not text:
        return
    for line in text.encode("utf-8", "surrogatepass").translate(_KEEP_LINES).split(b"\n"):
        words = line.split()
        for at in range(0, max(1, len(words) - STRETCH // 2), STRETCH // 2) if len(words) > STRETCH else [0]:
            if words:
                yield words[at : at + STRETCH]


def plain(words: list[bytes]) -> list[bytes]:
    """All numbers are one word."""
    return [b"0" if w.isdigit() else w for w in words]


def words_in(text: str) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split()


class Numbers(WordHashes):
    """All numbers are one word."""

    def array(self, words: list[bytes]) -> np.ndarray:
        return super().array(plain(words))


_STOPS = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in PLAIN], np.uint64))


def grams(found: list[list[bytes]], hashes: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, hash) of the distinct 1- to 3-grams of paragraphs, sorted by paragraph, and how many each has."""
    lengths = np.array([len(p) for p in found])
    h = hashes.array([w for p in found for w in p])
    row = np.repeat(np.arange(len(found)), lengths)
    two = (h[:-1] * _MIX + h[1:]) ^ (h[:-1] >> np.uint64(29))
    three = (two[:-1] * _MIX + h[2:]) ^ (two[:-1] >> np.uint64(29))
    single, pair, triple = ~_in(_STOPS, h), row[:-1] == row[1:], row[:-2] == row[2:]
    rows, codes = np.concatenate([row[single], row[:-1][pair], row[:-2][triple]]), np.concatenate([h[single], two[pair], three[triple]])
    first = np.sort(np.unique(codes + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1])
    first = first[np.argsort(rows[first], kind="stable")]
    return rows[first], codes[first], np.bincount(rows[first], minlength=len(found))


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys if len(table) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """features: sorted hashes of n-grams; weights: a row for each and two more, for the share of n-grams that are no
    feature and for the offset; calibration: slope and offset of the logistic curve over the log odds of any licence."""

    families: list[str]
    features: np.ndarray
    weights: np.ndarray
    threshold: float = 0.5
    calibration: tuple[float, float] = (1.0, 0.0)
    bigrams: dict[str, list[set[bytes]]] = field(default_factory=dict)

    def sparse(self, found: list[list[bytes]], hashes: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, feature) of each feature present, its value by paragraph, and the share of other n-grams."""
        rows, codes, sizes = grams(found, hashes)
        known = _in(self.features, codes)
        rows, codes = rows[known], codes[known]
        return rows, np.searchsorted(self.features, codes), 1 / np.sqrt(np.maximum(1, sizes)), 1 - np.bincount(rows, minlength=len(found)) / np.maximum(1, sizes)

    def scores(self, rows: np.ndarray, features: np.ndarray, value: np.ndarray, other: np.ndarray) -> np.ndarray:
        z = other[:, None] * self.weights[-2] * value[:, None] + self.weights[-1]
        if len(rows):
            begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            z[rows[begin]] += np.add.reduceat(self.weights[features], begin) * value[rows[begin]][:, None]
        return z

    def classified(self, found: list[list[bytes]], hashes: Numbers) -> tuple[np.ndarray, np.ndarray]:
        """Of each paragraph the likeliest family, and the calibrated probability that it is a licence."""
        z = self.scores(*self.sparse(found, hashes))
        slope, offset = self.calibration
        return z[:, :-1].argmax(1), 1 / (1 + np.exp(-np.clip(slope * odds(z) + offset, -30, 30)))

    def scan(self, texts: Iterable[str | None], hashes: Numbers) -> list[list[tuple[str, float, float, bool]]]:
        """(family, probability, likeness, confirmed) of each licence paragraph of each text."""
        out: list[list[tuple[str, float, float, bool]]] = []
        held: list[list[bytes]] = []
        of: list[int] = []

        def flush() -> None:
            family, p = self.classified(held, hashes)
            for k in np.flatnonzero(p >= self.threshold).tolist():
                name = self.families[family[k]]
                like = max(likeness(held[k], t) for t in self.bigrams[name])
                out[of[k]].append((name, float(p[k]), like, like >= CONFIRMED))

        for d, text in enumerate(texts):
            out.append([])
            for words in paragraphs(text):
                held.append(words)
                of.append(d)
                if len(held) >= BLOCK:
                    flush()
                    held, of = [], []
        if held:
            flush()
        return out


def odds(z: np.ndarray) -> np.ndarray:
    """Log odds of any family against unknown, the last."""
    top = z[:, :-1].max(1)
    return top + np.log(np.exp(z[:, :-1] - top[:, None]).sum(1)) - z[:, -1]


def pairs_of(words: list[bytes]) -> set[bytes]:
    w = plain(words)
    return {b" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or set(w)


def likeness(words: list[bytes], notice: set[bytes]) -> float:
    """The share of the smaller bigram set that both have, at least three bigrams being asked of either."""
    own = pairs_of(words)
    return len(own & notice) / max(3, min(len(own), len(notice)))


def varied(notice: list[bytes], noise: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A notice cut, thinned and surrounded at random."""
    w = list(notice)
    if len(w) > 12 and rng.random() < 0.5:
        at = int(rng.integers(0, len(w) - 10))
        w = w[at : at + int(rng.integers(10, 30))]
    if len(w) > 6:
        w = [x for x in w if rng.random() > 0.05] or w
    around = [noise[int(i)] for i in rng.integers(0, len(noise), int(rng.integers(0, 8)))] if noise and rng.random() < 0.5 else []
    return around + w if rng.random() < 0.5 else w + around


def resembling(words: list[bytes], notices: list[set[bytes]], content: frozenset[bytes]) -> bool:
    """Whether a paragraph speaks of licences or would be confirmed as one."""
    return bool(SPEAKS.search(b" ".join(words))) or not content.isdisjoint(words) and any(likeness(words, n) >= CONFIRMED for n in notices)


def fit(unknown: list[list[bytes]], seed: int = 3, copies: int = 24, rounds: int = 250, apart: list[list[bytes]] | None = None) -> Model:
    """The model of the notices against everyday sentences and the given unknown paragraphs.

    Calibration and threshold are set on the paragraphs `apart`, or on a third of the unknown ones that is not trained on."""
    draft = Draft([w for p in unknown for w in p], seed, copies)
    unknown, apart = ([p for p in ps if not resembling(p, draft.known, draft.content)] if ps is not None else None for ps in (unknown, apart))
    if apart is None:
        unknown, apart = [p for i, p in enumerate(unknown) if i % 3], unknown[::3]
    return draft.fitted(draft.points(unknown), draft.points(apart), rounds)


@dataclass
class Points:
    """Paragraphs as the model sees them: (paragraph, feature) of each feature present, the number of n-grams of each
    paragraph, and how many paragraphs each stands for."""

    rows: np.ndarray
    features: np.ndarray
    sizes: np.ndarray
    times: np.ndarray

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As of Model.sparse()."""
        sizes = np.maximum(1, self.sizes)
        return self.rows, self.features, 1 / np.sqrt(sizes), 1 - np.bincount(self.rows, minlength=len(sizes)) / sizes

    @property
    def total(self) -> int:
        return int(self.times.sum())

    def gradient(self, model: Model, kinds: np.ndarray | int, weight: np.ndarray | float) -> np.ndarray:
        """The gradient of the weighted loss, each paragraph being of its kind."""
        at, feature, value, other = self.values()
        z = model.scores(at, feature, value, other)
        d = np.exp(z - z.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(d)), kinds] -= 1
        scaled = d * (self.times * weight)[:, None]
        g = np.zeros_like(model.weights)
        g[-1] = scaled.sum(0)
        scaled *= value[:, None]
        g[-2] = other @ scaled
        if len(at):
            by, begin = self.by_feature
            g[feature[by[begin]]] += np.add.reduceat(scaled[at[by]], begin)
        return g

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(self.features, kind="stable")
        return by, np.flatnonzero(np.append(True, np.diff(self.features[by]) != 0))

    def margins(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of any licence, and how many paragraphs have them."""
        return odds(model.scores(*self.values())), self.times


def _points(batch) -> Points:
    """Of rows (size, features, times)."""
    each = [np.frombuffer(x, np.int32) for x in batch["features"].to_pylist()]
    lengths = np.array([len(x) for x in each], np.int64)
    return Points(np.repeat(np.arange(len(each)), lengths), np.concatenate([*each, np.zeros(0, np.int32)]).astype(np.int64), batch["size"].to_numpy(), batch["times"].to_numpy())


class FarPoints:
    """As Points, of a stored table (size, features, times) of any number of rows, which stay on the executors."""

    def __init__(self, rows: DataFrame):
        self.rows, self.total = rows, rows.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]

    def gradient(self, model: Model, kinds: int, weight: float) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((_points(b).gradient(model, kinds, weight) for b in sliced(batches, BLOCK) if b.num_rows), np.zeros_like(model.weights))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

        parts = self.rows.mapInArrow(released(add), "g array<double>").collect()
        return sum((np.array(r["g"]) for r in parts), np.zeros(model.weights.size)).reshape(model.weights.shape)

    def margins(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """As of Points, the log odds rounded to MARGIN."""
        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for points in (_points(b) for b in sliced(batches, BLOCK) if b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in points.margins(model)], names=["m", "times"])

        found = self.rows.mapInArrow(released(weigh), "m double, times long").groupBy(F.round(F.col("m") / MARGIN).cast("long").alias("m")).agg(F.sum("times").alias("times")).orderBy("m").collect()
        return np.array([r["m"] for r in found], float) * MARGIN, np.array([r["times"] for r in found], np.int64)


class Draft:
    """What the model learns beside the corpus: notices, varied among words of noise, and everyday sentences."""

    def __init__(self, noise: list[bytes], seed: int = 3, copies: int = 24):
        rng = np.random.default_rng(seed)
        families = sorted(NOTICES)
        notices = {f: [words_in(n) for n in NOTICES[f]] for f in families}
        self.content = frozenset(w for ns in notices.values() for n in ns for w in plain(n) if w not in PLAIN and w != b"0")
        noise = noise or words_in(" ".join(EVERYDAY))
        rows = [(varied(n, noise, rng), k) for k, f in enumerate(families) for n in notices[f] for _ in range(copies)]
        rows += [(n, k) for k, f in enumerate(families) for n in notices[f]]
        # Of unknown paragraphs those weigh most that share words with notices; some of the others keep the prior right.
        words = sorted(self.content)
        bad = [words_in(s) for s in EVERYDAY] * 3 + [[words[int(i)] for i in rng.integers(0, len(words), 8)] for _ in range(150)]
        # Paragraphs of words that no notice has, as a small corpus may hold too few to learn from.
        bad += [[b"w%d" % k for k in rng.integers(0, 100_000, int(n))] for n in rng.integers(1, 40, 150)]
        self.known = [pairs_of(n) for ns in notices.values() for n in ns]
        self.held = bad[::3]
        rows += [(p, len(families)) for i, p in enumerate(bad) if i % 3]
        self.rows, self.kinds = [p for p, _ in rows], np.array([k for _, k in rows])
        hashes = Numbers()
        _, codes, _ = grams([p for p, k in rows if k < len(families)], hashes)
        seen, times = np.unique(codes, return_counts=True)
        features = np.intersect1d(seen[times >= 2], grams([n for ns in notices.values() for n in ns], hashes)[1])
        self.model = Model(families, features, np.zeros((len(features) + 2, len(families) + 1)), bigrams={f: [pairs_of(n) for n in ns] for f, ns in notices.items()})
        self.fresh = [varied(n, noise, rng) for ns in notices.values() for n in ns for _ in range(8)]

    def points(self, found: list[list[bytes]]) -> Points:
        """The model's view of paragraphs, in their order."""
        if not found:
            return Points(*(np.zeros(0, np.int64) for _ in range(4)))
        rows, codes, sizes = grams(found, Numbers())
        known = _in(self.model.features, codes)
        return Points(rows[known], np.searchsorted(self.model.features, codes[known]), sizes, np.ones(len(found), np.int64))

    def fitted(self, unknown: Points | FarPoints, apart: Points | FarPoints, rounds: int = 250) -> Model:
        """The model after gradient descent with all unknown points, calibration and threshold by those apart."""
        model, none = self.model, len(self.model.families)
        own = self.points(self.rows)
        # Each kind weighs alike, and of one kind each paragraph.
        counts = np.bincount(self.kinds, minlength=none + 1)
        counts[none] += unknown.total
        weight = 1 / counts / len(counts)
        velocity = np.zeros_like(model.weights)
        for _ in range(rounds):
            g = 1e-4 * model.weights + own.gradient(model, self.kinds, weight[self.kinds])
            if unknown.total:
                g += unknown.gradient(model, none, weight[none])
            velocity = 0.9 * velocity - 2.0 * g
            model.weights = model.weights + velocity
        fresh, n_fresh = self.points(self.fresh).margins(model)
        m, times = (np.append(x, y) for x, y in zip(self.points(self.held).margins(model), apart.margins(model) if apart.total else ((), ()), strict=True))
        model.calibration = _calibrated(np.append(fresh, m), np.arange(len(fresh) + len(m)) < len(fresh), np.append(n_fresh, times))
        slope, offset = model.calibration
        order, total = np.argsort(m), int(times.sum())
        place = min(total - 1, int(total * (1 - FALSE_ALARMS)))
        least = m[order[np.searchsorted(np.cumsum(times[order]), place, side="right")]]
        model.threshold = float(max(0.5, 1 / (1 + np.exp(-np.clip(slope * least + offset, -30, 30)))))
        return model


def _calibrated(m: np.ndarray, licence: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both sides weighing alike, with targets drawn in from 0 and 1."""
    n, k = max(1, int(times[licence].sum())), max(1, int(times[~licence].sum()))
    target, weight = np.where(licence, (n + 1) / (n + 2), 1 / (k + 2)), times * np.where(licence, 0.5 / n, 0.5 / k)
    x, w = np.stack([m, np.ones(len(m))], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (weight * (p - target)))
        w = w - move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
    return float(max(w[0], 0.05)), float(w[1])


def train(docs: DataFrame, text: str = "text", rows: int | None = None, held: int = HELD_ROWS, seed: int = 17, near: int = NEAR_ROWS) -> Model:
    """A model whose unknown class is every distinct paragraph of docs, from all texts and all their places: one in
    HELD_OUT, by its hash, sets calibration and threshold, and all others train. With `rows`, it is fitted on a draw in
    their place, of about so many to train and `held` for the rest."""
    if rows is not None:
        return _train_on_draw(docs, text, rows, held, seed)
    draft = Draft([b"w%d" % k for k in range(5000)])
    found = seen(docs, draft, text, seed)
    few_rows = found.limit(near + 1).count() <= near
    parts = [found.where(F.col("apart") == apart).select("size", "features", "times") for apart in (False, True)]
    return draft.fitted(*[_points(p.orderBy("size", "features").toArrow()) if few_rows else FarPoints(p) for p in parts])


def seen(docs: DataFrame, draft: Draft, text: str = "text", seed: int = 17) -> DataFrame:
    """(apart, size, features, times) of all distinct paragraphs that resemble no notice, as the model sees them: most
    hold few n-grams of notices, so that many look alike."""
    shared = docs.sparkSession.sparkContext.broadcast((draft.model.features, draft.known, draft.content))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, notices, content = shared.value
        pairs, hashes = _pair_codes(notices), Numbers()

        def of(held: list[list[bytes]]) -> pa.RecordBatch:
            joined = [b" ".join(p) for p in held]
            rows, codes, sizes = grams(held, hashes)
            # With less than two bigrams of notices no likeness is enough.
            like = np.bincount(rows[_in(pairs, codes)], minlength=len(held)) >= 2
            keep = [not (resembling(p, notices, content) if x else SPEAKS.search(j)) for p, j, x in zip(held, joined, like, strict=True)]
            known = _in(features, codes)
            rows, place = rows[known], np.searchsorted(features, codes[known]).astype(np.int32)
            place, cut = place[np.lexsort((place, rows))], np.searchsorted(rows, np.arange(len(held) + 1))
            h = np.array([xxhash.xxh3_64_intdigest(j, seed) for j in joined], np.uint64).view(np.int64)
            seen_ = pa.array([place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(sizes.astype(np.int64)), seen_], names=["h", "size", "features"]).filter(pa.array(keep, pa.bool_()))

        for batch in sliced(batches):
            held: list[list[bytes]] = []
            for words in (p for t in batch.column(0) for p in paragraphs(t.as_py())):
                held.append(words)
                if len(held) >= BLOCK:
                    yield of(held)
                    held = []
            if held:
                yield of(held)

    each = docs.select(text).mapInArrow(released(view), "h long, size long, features binary").distinct()
    apart = F.pmod("h", F.lit(HELD_OUT)) == 0
    return stored(each.groupBy(apart.alias("apart"), "size", "features").agg(F.count(F.lit(1)).alias("times")), "paragraphs")


def _pair_codes(notices: list[set[bytes]]) -> np.ndarray:
    """The hashes of all bigrams of notices, sorted, as grams() makes them."""
    hashes = Numbers()
    two = np.array([hashes.array(b.split()) for n in notices for b in n if b" " in b], np.uint64)
    return np.unique((two[:, 0] * _MIX + two[:, 1]) ^ (two[:, 0] >> np.uint64(29)))


def _train_on_draw(docs: DataFrame, text: str, rows: int, held: int, seed: int) -> Model:
    """As train(), on distinct paragraphs drawn by their hash from all texts and all their places."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + F.length(text) / F.lit(120) + 1
    total = docs.agg(F.coalesce(F.sum(lines), F.lit(0.0))).first()[0]
    below = int(min(1.0, 1.2 * (rows + held) / max(1.0, total)) * ((1 << 64) - 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = (b" ".join(p) for t in batch.column(0) for p in paragraphs(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p in found if xxhash.xxh3_64_intdigest(p, seed) <= below], pa.binary())], names=["p"])

    drawn = sorted((bytes(r[0]) for r in docs.select(text).mapInArrow(draw, "p binary").distinct().collect()), key=lambda p: (xxhash.xxh3_64_intdigest(p, seed + 1), p))
    cut = min(rows, -(-len(drawn) // 3))
    return fit([p.split() for p in drawn[:cut]], apart=[p.split() for p in drawn[cut:]])


def licences(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """An array column of structs: family, probability, likeness, confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))
    names = ("family", "probability", "likeness", "confirmed")

    @F.arrow_udf("struct<found:array<struct<family:string,probability:double,likeness:double,confirmed:boolean>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Numbers()
        for batch in sliced(batches):
            found = [[dict(zip(names, x, strict=True)) for x in each] for each in shared.value.scan((t.as_py() for t in batch), hashes)]
            yield struct_array({"found": pa.array(found, kind)})

    return scan(docs[text])["found"]
