"""License scans: a paragraph classifier over sparse word n-grams, confirmed against templates.

A multinomial logistic regression tells licence families from ordinary text and from legal talk
that names no licence.  It is trained here, on variations of the templates below and on lines of
the corpus itself.  Its probabilities are scaled, and the threshold of the unknown class is set, on
templates that the model of their fold has not seen; a licence-like paragraph whose best family
stays under that threshold, or whose words don't cover a template of that family, is reported as
``unknown``.  A paragraph's lines are looked at one by one and as runs that cover a template, for
corpora also have notices inside running text without blank lines around them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.common import table

#: The wording of well-known licence notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "Released into the public domain under the Creative Commons Zero waiver."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved."],
}
#: Talk of licences and rights that grants none.
LEGAL_TALK = [
    "A driving license is required for this job.", "The license was revoked by the state.", "She studies copyright law at the university.", "Version 2.0 of the program was released today.",
    "The general public is invited.", "Permission to enter was granted.", "Software licenses are hard to read.", "He reserved all seats and claimed his rights.", "The software foundation published its report.",
    "This license agreement is governed by local law.", "Please read the terms of the license before use.", "The work was released under a new title.",
]
FAMILIES = ["none", "legal", *TEMPLATES]
#: Documents whose lines teach the model ordinary text, and lines taken of them, at most.  A line is the set of
#: its n-grams that are in the vocabulary, whatever its length.
SAMPLE_DOCUMENTS = 400
SAMPLE_LINES = 4000
#: Templates and other texts are dealt to so many folds to scale probabilities and set the threshold.
FOLDS = 3
VARIATIONS = 24
STEPS = 160
COVERAGE = 0.7
#: Words from the first to the last of a wrapped notice, at most: so many times its template's, and some.
REACH, MORE = 2, 10
#: Comment leaders that are words.
_LEADER = re.compile(rb"\n[ \t]*(?:dnl|rem)(?![0-9A-Za-z\x80-\xff])", re.IGNORECASE)

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = np.uint64((1 << 20) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line, order) of all word 1- to 3-grams; ``offsets`` bound the lines."""
    data = kernels.LOWER[data]
    starts, ends = kernels.runs(_ALNUM[data], offsets)
    h, first, order = _chains(kernels.span_hashes(data, starts, ends), line := np.searchsorted(offsets, starts, "right") - 1)
    return h, line[first], order


def _chains(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, order) of all 1- to 3-grams of the words ``h`` inside lines."""
    hashes, firsts, orders = [h], [np.arange(len(h))], [np.ones(len(h), np.int8)]
    chain = h
    for n in (2, 3):
        chain = kernels.mix(chain[:-1] * kernels._A + h[n - 1 :]) if len(h) >= n else np.zeros(0, np.uint64)
        inside = line[n - 1 :] == line[: max(0, len(line) - n + 1)]
        hashes.append(chain[inside])
        firsts.append(np.flatnonzero(inside))
        orders.append(np.full(int(inside.sum()), n, np.int8))
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(orders)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


class Vocabulary:
    """The n-grams of templates and legal talk; others carry no weight."""

    def __init__(self) -> None:
        self.families = [f for f, ts in TEMPLATES.items() for _ in ts]
        h, line, order = grams(*_joined([t for ts in TEMPLATES.values() for t in ts]))
        talk, _, _ = grams(*_joined(LEGAL_TALK))
        self.hashes = np.unique(np.concatenate((h, talk)))
        self.maybe = np.zeros(int(_MASK) + 1, bool)
        self.maybe[(self.hashes & _MASK).astype(np.int64)] = True
        # template comparison: the distinct 2- and 3-grams of every template
        self.templates = np.zeros((len(self.families), len(self.hashes)), np.float32)
        at = np.searchsorted(self.hashes, h)
        self.templates[line[order > 1], at[order > 1]] = 1
        self.sizes = np.maximum(self.templates.sum(1), 1)
        self.reach = REACH * np.bincount(line[order == 1], minlength=len(self.families)) + MORE

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, place in the vocabulary), distinct, in order."""
        h, line, _ = grams(data, offsets)
        known, at = self._known(h)
        return self._distinct(line[known], at)

    def places_of(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the places of its n-grams in the vocabulary."""
        line, at = self.hits(*_joined(texts))
        return np.split(at, np.searchsorted(line, np.arange(1, len(texts))))

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.maybe[(h & _MASK).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        known = self.hashes[at] == h[near]
        return near[known], at[known]

    def _distinct(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(line * np.int64(len(self.hashes)) + at)
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def places(self, data: np.ndarray, units: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, ...]:
        """(unit, place in the vocabulary, first word, last word) of all known n-grams by unit and word, and each word's line."""
        data = kernels.LOWER[data]
        starts, ends = kernels.runs(_ALNUM[data], units)
        unit = np.searchsorted(units, starts, "right") - 1
        h, first, order = _chains(kernels.span_hashes(data, starts, ends), unit)
        known, at = self._known(h)
        first, last = first[known], first[known] + order[known] - 1
        by = np.lexsort((last, first))
        return unit[first[by]], at[by], first[by], last[by], np.searchsorted(lines, starts, "right") - 1

    def coverage(self, x: np.ndarray) -> np.ndarray:
        """Of each row's presence vector, the share of each template's n-grams in it."""
        return (x @ self.templates.T) / self.sizes


def _dense(line: np.ndarray, at: np.ndarray, rows: int, width: int) -> np.ndarray:
    x = np.zeros((rows, width), np.float32)
    x[line, at] = 1
    return x


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _variations(vocabulary: Vocabulary, rng: np.random.Generator, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(presence vectors, labels, folds) of templates and legal talk with a word lost, names and years around them, or inside ordinary text.

    All variations of a template are in one fold.
    """
    texts, labels, folds, inside = [], [], [], []
    for f, family in enumerate(FAMILIES[1:], 1):
        for n, t in enumerate(LEGAL_TALK if family == "legal" else TEMPLATES[family]):
            for k in range(VARIATIONS if family != "legal" else VARIATIONS // 2):
                w = t.split()
                if k and len(w) > 6 and k % 3 == 0:
                    del w[int(rng.integers(len(w)))]
                before = ["", "Copyright (c) 2021 Jane Doe.", "This file is part of Foo.", ""][k % 4]
                texts.append(" ".join([before, *w, ["", "See LICENSE for details.", ""][k % 3]]))
                labels.append(f)
                folds.append(n % FOLDS)
                inside.append(k % 4 == 3 or k % 3 == 2)
    line, at = vocabulary.hits(*_joined(texts))
    x = _dense(line, at, len(texts), len(vocabulary.hashes))
    around = np.flatnonzero(inside)
    x[around] = np.maximum(x[around], ordinary[rng.integers(len(ordinary), size=len(around))])
    return x, np.array(labels), np.array(folds)


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression in which all classes weigh the same."""
    onehot = np.eye(len(FAMILIES), dtype=np.float32)[y]
    share = (1 / np.maximum(onehot.sum(0), 1))[y, None]
    share /= share.sum()
    weights, bias = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    last_w, last_b = weights, bias
    for step in range(STEPS):  # accelerated gradient steps
        pull = step / (step + 3)
        w, b = weights + pull * (weights - last_w), bias + pull * (bias - last_b)
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        g = share * (z / z.sum(1, keepdims=True) - onehot)
        last_w, last_b = weights, bias
        weights, bias = w - 4.0 * (x.T @ g + 1e-5 * w), b - 4.0 * g.sum(0)
    return weights, bias


def fit(ordinary: list[np.ndarray], seed: int = 7) -> Model:
    """Train on template variations and lines of ordinary text (those that cover half a template left out).

    ``ordinary`` has lines as ``Vocabulary.places_of`` gives them.  The model of each fold meets the
    templates of that fold for the first time: what it then says gives the heat, from the families
    that it knows by other templates, and the threshold, from all that it takes for another family.
    """
    vocabulary = Vocabulary()
    width, rng = len(vocabulary.hashes), np.random.default_rng(seed)
    ordinary = [*ordinary, *vocabulary.places_of(["", "A few plain words.", "The quick brown fox jumps over the lazy dog."])]
    line = np.repeat(np.arange(len(ordinary)), [len(p) for p in ordinary])
    x0 = _dense(line, np.concatenate(ordinary).astype(np.int64), len(ordinary), width)
    x0 = x0[vocabulary.coverage(x0).max(1) < 0.5]
    xv, yv, fv = _variations(vocabulary, rng, x0)
    x, y, fold = np.concatenate((x0, xv)), np.concatenate((np.zeros(len(x0), np.int64), yv)), np.concatenate((np.arange(len(x0)) % FOLDS, fv))
    model = Model(vocabulary, *_regression(x, y), 1.0, 0.5)
    seen, best, truth = [], [], []
    for f in range(FOLDS):
        held = fold == f
        weights, bias = _regression(x[~held], y[~held])
        seen.append(x[held] @ weights + bias)
        truth.append(np.where(np.isin(y[held], y[~held]), y[held], -1))  # -1: nothing of that family was there to learn
    z, truth = np.concatenate(seen), np.concatenate(truth)

    def scaled(heat: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / heat)
        return p / p.sum(1, keepdims=True)

    heats, known = np.geomspace(0.2, 5, 25), np.flatnonzero(truth >= 0)
    model.heat = float(heats[np.argmin([-np.log(np.maximum(scaled(h)[known, truth[known]], 1e-9)).mean() for h in heats])])
    p = scaled(model.heat)
    best = p.argmax(1)
    wrong = p.max(1)[(best > 1) & (best != truth)]
    model.threshold = float(np.clip(np.quantile(wrong, 0.95) if len(wrong) else 0, 0.5, 0.9))
    return model


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with a word of every text, as places in the vocabulary."""
    vocabulary = Vocabulary()
    for batch in batches:
        for row, _, data, offsets in kernels.pieces(batch.column(1)):
            bounds = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
            starts, _ = kernels.runs(_ALNUM[data], bounds)
            full = np.unique(np.searchsorted(bounds, starts, "right") - 1)
            line, at = vocabulary.hits(data, bounds)
            found = np.split(at, np.searchsorted(line, full)[1:]) if len(full) else []
            doc = np.searchsorted(offsets, bounds[full], "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + doc)), pa.array(full - np.searchsorted(bounds, offsets[doc]), pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "line", "places"])


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of lines; a document that is there several times counts once."""
    chosen = docs.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_DOCUMENTS)
    lines = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").mapInArrow(_sample, "doc_id bigint, line int, places array<int>")
    rows = lines.distinct().orderBy(F.md5(F.concat_ws("/", "doc_id", "line")), "doc_id", "line", "places").limit(SAMPLE_LINES).select("places").collect()
    return fit([np.array(r[0], np.int64) for r in rows])


def _paragraphs(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the paragraphs of several lines; texts' ends, and lines without words, end one."""
    starts, _ = kernels.runs(_ALNUM[data], bounds)
    full = np.zeros(len(bounds) - 1, bool)
    full[np.searchsorted(bounds, starts, "right") - 1] = True
    first, last = kernels.runs(full, np.searchsorted(bounds, offsets))
    many = last - first > 1
    return first[many], last[many] - 1


def _covering(at: np.ndarray, a: np.ndarray, b: np.ndarray, lines: tuple[np.ndarray, np.ndarray], size: float, reach: int) -> list[tuple[int, int]]:
    """Of a template's n-grams in a paragraph, the runs of lines that cover it; ``a``, ``b`` are their first and last words."""
    out: list[tuple[int, int]] = []
    la, lb = lines

    def inside(x: int, y: int) -> int:
        near = slice(*np.searchsorted(la, (x, y + 1)))
        return len(np.unique(at[near][lb[near] <= y]))

    count: dict[int, int] = {}
    left, k = 0, 0
    while k < len(at):
        count[int(at[k])] = count.get(int(at[k]), 0) + 1
        while left < k and (count[int(at[left])] > 1 or b[k] - a[left] >= reach):
            g = int(at[left])
            count[g] -= 1
            if not count[g]:
                del count[g]
            left += 1
        k += 1
        if len(count) < COVERAGE * size - 1e-6:
            continue
        lo, hi = int(la[left]), int(lb[left:k].max())
        while True:  # neighbouring lines that cover more, by two n-grams at least
            now = inside(lo, hi) + 1
            if inside(lo, hi + 1) > now:
                hi += 1
            elif (not out or lo - 1 > out[-1][1]) and inside(lo - 1, hi) > now:
                lo -= 1
            else:
                break
        enough = lambda x, y: inside(x, y) >= max(COVERAGE * size - 1e-6, inside(lo, hi) - 1)  # noqa: B023, E731
        while lo < hi and enough(lo + 1, hi):  # lines at the ends that share one by chance
            lo += 1
        while lo < hi and enough(lo, hi - 1):
            hi -= 1
        out.append((lo, hi))
        count = {}
        while k < len(at) and la[k] <= hi:
            k += 1
        left = k
    return out


#: First line, last line, family, probability, coverage, confirmed.
Found = tuple[int, int, str, float, float, bool]


def _judged(model: Model, x: np.ndarray) -> tuple[int, float, float, bool]:
    """The best family of a presence vector, its probability and coverage, and whether they confirm it."""
    p = model.probabilities(x[None])[0]
    best = int(p[2:].argmax()) + 2
    own = float(model.vocabulary.coverage(x[None])[0][np.array(model.vocabulary.families) == FAMILIES[best]].max())
    return best, float(p[best]), own, bool(p[best] >= model.threshold and own >= COVERAGE)


def _notice(model: Model, presence: Callable[[int, int], np.ndarray], span: tuple[int, int], single: list[Found]) -> tuple[list[Found], list[Found]]:
    """Findings in a run of lines, and those of its single lines that they replace; ``presence`` gives lines' vectors."""
    families, sets = np.array(model.vocabulary.families), model.vocabulary.templates > 0
    y = presence(*span)
    taken = np.zeros(len(y), bool)

    def alone(family: str, y: np.ndarray) -> bool:
        """Whether a template of the family is covered, also in what it doesn't share with families found."""
        return any((t & ~taken).any() and y[t].mean() >= COVERAGE and y[t & ~taken].mean() >= COVERAGE for t in sets[families == family])

    best, p, c, sure = _judged(model, y)
    if not sure:
        return ([], []) if any(f[5] for f in single) else ([(*span, "unknown", p, c, False)], single)
    out: list[Found] = []
    found = set()
    for name in (FAMILIES[best], *TEMPLATES):
        if name in found or not alone(name, y):
            continue
        own = sets[families == name].any(0)
        best, p, c, sure = _judged(model, np.where(taken & ~own, 0, y).astype(np.float32))
        if sure and FAMILIES[best] == name:
            if not any(f[2] == name and f[4] >= c - 1e-6 for f in single):
                out.append((*span, name, p, c, True))
            found.add(name)
            taken |= own
    new = {f[2] for f in out}
    gone = [f for f in single if found and not f[5] or out and (f[2] in new or f[2] not in found and not alone(f[2], presence(f[0], f[0])))]
    return out, gone


def _wrapped(model: Model, data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, single: list[Found]) -> list[Found]:
    """``single``, the findings of lines, with those of paragraphs; a notice is found once."""
    vocabulary = model.vocabulary
    start, stop = _paragraphs(data, offsets, bounds)
    if not len(start):
        return single
    if _LEADER.search(raw := data.tobytes()):
        data = np.frombuffer(_LEADER.sub(lambda m: b"\n" + b" " * (len(m[0]) - 1), raw), np.uint8)
    units = np.unique(np.concatenate(([0, len(data)], bounds[start], bounds[stop + 1])))
    mine = np.searchsorted(units, bounds[start])
    unit, at, first, last, line = vocabulary.places(data, units, bounds)
    ends = np.searchsorted(unit, np.arange(len(units)))
    u, v = vocabulary._distinct(unit, at)
    many = np.flatnonzero(np.diff(np.searchsorted(u, np.arange(len(units))))[mine] >= 3)
    lines = np.array([f[0] for f in single], np.int64)
    gone: set[Found] = set()
    out: list[Found] = []
    for i in range(0, len(many), 2000):
        part = many[i : i + 2000]
        inside = np.isin(u, mine[part])
        x = _dense(np.searchsorted(mine[part], u[inside]), v[inside], len(part), len(vocabulary.hashes))
        covered, like = vocabulary.coverage(x), model.probabilities(x)[:, 2:].sum(1) > 0.5
        for k in np.flatnonzero(like | (covered.max(1) >= COVERAGE)):
            here = slice(ends[mine[part[k]]], ends[mine[part[k]] + 1])
            g, a, b = at[here], first[here], last[here]
            la, lb = line[a], line[b]

            def presence(s: int, e: int) -> np.ndarray:
                y = np.zeros(len(vocabulary.hashes), np.float32)
                near = slice(*np.searchsorted(la, (s, e + 1)))  # noqa: B023
                y[g[near][lb[near] <= e]] = 1  # noqa: B023
                return y

            spans: list[tuple[int, int]] = []
            for t in np.flatnonzero(covered[k] >= COVERAGE):
                m = vocabulary.templates[t, g] > 0
                spans += _covering(g[m], a[m], b[m], (la[m], lb[m]), float(vocabulary.sizes[t]), int(vocabulary.reach[t]))
            runs: list[tuple[int, int]] = []
            for s, e in sorted(spans):
                if runs and s <= runs[-1][1]:
                    runs[-1] = runs[-1][0], max(runs[-1][1], e)
                else:
                    runs.append((s, e))
            lo, hi = int(start[part[k]]), int(stop[part[k]])
            of = lambda s, e: single[np.searchsorted(lines, s) : np.searchsorted(lines, e + 1)]
            new: list[Found] = []
            for s, e in runs:
                if s < e:
                    more, less = _notice(model, presence, (s, e), of(s, e))
                    new += more
                    gone.update(less)
            if like[k] and not new and not of(lo, hi):
                best, p, c, _ = _judged(model, x[k])
                new.append((lo, hi, "unknown", p, c, False))
            out += new
    return sorted([f for f in single if f not in gone] + out)


FOUND = "doc_id bigint, line int, family string, probability double, coverage double, confirmed boolean, paragraph string"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each line or run of a paragraph's lines that holds a licence notice, or one of an unknown kind.

    Null, empty and blank texts have none.  Repeated documents are reported each; very long texts and
    lines are read whole, and columns but doc_id and text are not read.  ``line`` is the notice's first,
    ``paragraph`` all of its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary
        families = np.array(vocabulary.families)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, _, data, offsets in kernels.pieces(batch.column(1)):
                bounds = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
                line, at = vocabulary.hits(data, bounds)
                many, first = np.unique(line, return_index=True)
                sizes = np.diff(np.append(first, len(line)))
                many = many[sizes >= 3]  # fewer known n-grams than the shortest template has
                single: list[Found] = []
                for i in range(0, len(many), 2000):
                    part = many[i : i + 2000]
                    inside = np.isin(line, part)
                    x = _dense(np.searchsorted(part, line[inside]), at[inside], len(part), len(vocabulary.hashes))
                    p = model.probabilities(x)
                    covered = vocabulary.coverage(x)
                    for k in np.flatnonzero((p[:, 2:].sum(1) > 0.5) | (covered.max(1) >= COVERAGE)):
                        best = int(p[k, 2:].argmax()) + 2
                        own = float(covered[k][families == FAMILIES[best]].max())
                        sure = bool(p[k, best] >= model.threshold and own >= COVERAGE)
                        single.append((int(part[k]), int(part[k]), FAMILIES[best] if sure else "unknown", float(p[k, best]), own, sure))
                out: list[tuple] = []
                for top, end, *found in _wrapped(model, data, offsets, bounds, single):
                    a, b = int(bounds[top]), int(bounds[end + 1])
                    doc = int(np.searchsorted(offsets, a, "right")) - 1
                    place = int((data[offsets[doc] : a] == 10).sum())
                    out.append((ids[row + doc], place, *found, data[a:b].tobytes().decode().rstrip("\n")))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def op5_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every text of ``documents``; see ``scan``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
