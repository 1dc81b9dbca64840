"""Licence notices: paragraphs classified by word n-grams, with an unknown class and a template check."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hash_share

# --- Fixed values: notices of each family, sentences that only sound like one, other licences. ---
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2",
        "Licensed under the GPLv3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License",
        "Licensed under the BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    "cc0": (
        "Released under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal",
    ),
}
LOOKALIKES = (
    "He was released from prison under the terms of a licence",
    "The general public was granted access to the work without charge",
    "A licensed physician must be present at all times",
    "Students of MIT met under the bridge",
    "She lost her driving license on the way to work",
    "The Apache helicopter was used in version 2 of the plan",
    "All permission notices are to be included in the file",
    "The conditions of the public library are listed below",
    "They drove under the creative direction of a common friend",
    "Attribution of the work to the master is not certain",
    "This work is the property of the foundation",
    "Free software is distributed by the university",
    "The software comes with a license key",
    "Version 3 of the program was published in June",
)
OTHERS = (
    "Licensed under the Apache License, Version 1.1",
    "Licensed under the Mozilla Public License, version 1.1",
    "Distributed under the Boost Software License, Version 1.0",
    "Released under the zlib License",
    "Licensed under the Eclipse Public License, version 2.0",
    "Licensed under the Artistic License 2.0",
    "Licensed under the European Union Public Licence, version 1.2",
    "Released under the Python Software Foundation License",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: EPL-2.0",
    "This program is licensed under a commercial license, all rights reserved",
)
# --- End of fixed values. ---

TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
PLACED = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)")
UNKNOWN = "unknown"


@dataclass(frozen=True)
class LicenseParams:
    """About ``sample`` documents give the paragraphs without a notice that are learned from, ``lines``
    different ones at most, chosen by hash; ``variants`` of each template are made up. A paragraph is reported if its family has at least
    ``least`` calibrated probability, confirmed if ``similar`` of a template's trigrams are in it."""

    sample: int = 400
    lines: int = 8_000
    variants: int = 24
    least: float = 0.5
    similar: float = 0.6
    ridge: float = 1e-3
    steps: int = 400
    seed: int = 11


@dataclass(frozen=True)
class LicenseModel:
    """Weights of word n-grams by family, the last column for the unknown class."""

    families: tuple[str, ...]
    features: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    shingles: tuple[tuple[str, frozenset], ...]  # family and word trigrams of every template


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(words: list[str], n: int):
    return zip(*(words[i:] for i in range(n)))


def _template_shingles() -> tuple[tuple[str, frozenset], ...]:
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = tokens(text)
            out.append((family, frozenset(grams(words, min(3, len(words))))))
    return tuple(out)


def _vocabulary() -> dict[tuple[str, ...], int]:
    held = {g for texts in TEMPLATES.values() for t in texts for n in (1, 2, 3) for g in grams(tokens(t), n)}
    return {g: i for i, g in enumerate(sorted(held))}


class _Finder:
    """Features of paragraphs. Longer n-grams are looked for only where shorter ones were found."""

    def __init__(self, features: dict[tuple[str, ...], int]):
        self.features = features
        self.by_size = [{g for g in features if len(g) == n} for n in (1, 2, 3)]
        self.words = {g[0] for g in self.by_size[0]}

    def __call__(self, words: list[str]) -> list[int]:
        found = self.words.intersection(words)
        if not found:
            return []
        held = [(w,) for w in found]
        for n in (2, 3):
            more = self.by_size[n - 1].intersection(grams(words, n))
            if not more:
                break
            held += more
        return sorted(self.features[g] for g in held)


def _version(word: str) -> str | None:
    """A version number without a leading v and final zeros, or None."""
    found = VERSION.fullmatch(word)
    return re.sub(r"(\.0)+$", "", found[1]) if found else None


def other_version(family: str, words: list[str]) -> bool:
    """Whether the family is one version of a licence and the words only name others."""
    own = _version(family.rpartition("-")[2])
    named = {_version(b) for a, b in grams(words, 2) if a in ("version", "v", "license", "licence")} - {None}
    return own is not None and bool(named) and own not in named


def similarity(model: LicenseModel, family: str, words: list[str]) -> float:
    """The largest share of a template's trigrams that the words hold, over the family's templates;
    0 if they name another version of the licence."""
    if other_version(family, words):
        return 0.0
    own = {n: set(grams(words, n)) for n in (1, 2, 3)}
    best = 0.0
    for name, shingles in model.shingles:
        if name == family:
            size = len(next(iter(shingles)))
            best = max(best, len(shingles & own[size]) / len(shingles))
    return best


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_licenses(docs: DataFrame, params: LicenseParams = LicenseParams()) -> LicenseModel:
    """Fit on variants of the templates, look-alikes and paragraphs of a bounded sample of ``docs``.

    Sampled paragraphs that hold a good part of a template are left out. The temperature that makes
    the probabilities honest is set on rows that the weights have not seen: two halves are fitted,
    each judged on the other, and a template lies with all its variants in one of them. The weights
    themselves are then fitted on all rows.
    """
    features, shingles = _vocabulary(), _template_shingles()
    families = (*TEMPLATES, UNKNOWN)
    finder = _Finder(features)
    unlike = LicenseModel(families, features, np.zeros((0, 0)), np.zeros(0), 1.0, shingles)

    def sampled(frames):
        for frame in frames:
            rows = set()
            for text in frame["text"]:
                for _, _, words in paragraphs(text or ""):
                    if max(similarity(unlike, f, words) for f in TEMPLATES) < 0.3:
                        rows.add(tuple(finder(words)))
            yield pd.DataFrame({"ids": pd.Series([list(r) for r in sorted(rows)], dtype=object)})

    n = max(1, docs.count())
    some = docs.select("text").filter("text is not null").filter(hash_share(F.col("text"), min(1.0, params.sample / n)))
    ids = some.mapInPandas(sampled, "ids array<int>").distinct()
    ids = ids.orderBy(F.xxhash64("ids"), "ids").limit(params.lines).toPandas()["ids"]
    rng = np.random.default_rng(params.seed)
    rows: list[tuple[list[int], int, int]] = []  # features, class, half
    for k, texts in enumerate(TEMPLATES.values()):
        for i, text in enumerate(texts):
            words = tokens(text)
            for v in range(params.variants):
                keep = words if v % 4 == 0 or len(words) < 5 else [w for w in words if rng.random() > 0.12]
                rows.append((finder(keep), k, i % 2))
    for i, text in enumerate(LOOKALIKES + OTHERS):
        rows += [(finder(tokens(text)), len(TEMPLATES), i % 2)] * params.variants
    rows += [(list(r), len(TEMPLATES), i % 2) for i, r in enumerate(ids)]
    rows += [([], len(TEMPLATES), half) for half in (0, 1) for _ in range(params.variants)]
    x = np.zeros((len(rows), len(features)))
    for i, (held, _, _) in enumerate(rows):
        x[i, held] = 1
    y = np.eye(len(families))[[k for _, k, _ in rows]]
    half = np.array([h for _, _, h in rows])
    logits = np.zeros(y.shape)
    for h in (0, 1):
        w, b = _descend(x[half != h], y[half != h], params)
        logits[half == h] = x[half == h] @ w + b
    losses = {
        t: -float(np.log((_softmax(logits / t) * y).sum(1) + 1e-12).sum())
        for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    }
    w, b = _descend(x, y, params)
    return LicenseModel(families, features, w, b, min(losses, key=losses.get), shingles)


def _descend(x, y, params) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    w_seen, b_seen, t_seen, total = w, b, 1.0, len(x)
    rate = 4.0 / max(1.0, float(x.sum(axis=1).mean()))
    w_now, b_now = w, b
    for _ in range(params.steps):
        error = (_softmax(x @ w_now + b_now) - y) / total
        w = w_now - rate * (x.T @ error + params.ridge * w_now)
        b = b_now - rate * error.sum(axis=0)
        t = (1 + (1 + 4 * t_seen * t_seen) ** 0.5) / 2
        push = (t_seen - 1) / t
        w_now, b_now = w + push * (w - w_seen), b + push * (b - b_seen)
        w_seen, b_seen, t_seen = w, b, t
    return w, b


def paragraphs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of each line that has a word."""
    start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        words = tokens(text[start:end])
        if words:
            yield start, end, words
        start = end + 1


def blocks(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of each run of lines that all have a word; a line of comment marks only
    ends it, other comment marks are no words."""
    start, end, held = 0, -2, []
    for a, b, words in paragraphs(text):
        if held and a != end + 1:
            yield start, end, held
            held = []
        if not held:
            start = a
        held.extend(words)
        end = b
    if held:
        yield start, end, held


class _Windows:
    """The windows of a block that hold enough of a template, each as long as what was found."""

    def __init__(self, model: LicenseModel, similar: float):
        self.similar, self.shingles = similar, model.shingles
        self.of: dict[tuple[str, ...], list[int]] = {}
        for t, (_, shingles) in enumerate(model.shingles):
            for gram in shingles:
                self.of.setdefault(gram, []).append(t)

    def __call__(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """First and last word, exclusive. Of a template, matches that lie within one and a half
        lengths are taken together, without overlap."""
        places: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for n in (2, 3):
            if not self.of.keys() & set(grams(words, n)):
                continue
            for i, gram in enumerate(grams(words, n)):
                for t in self.of.get(gram, ()):
                    places.setdefault(t, []).append((i, gram))
        for t, found in places.items():
            shingles = self.shingles[t][1]
            reach, size, first = 1.5 * (len(shingles) + 2), len(next(iter(shingles))), 0
            while first < len(found):
                near = [(i, g) for i, g in found[first : first + int(reach) + 1] if i < found[first][0] + reach]
                if len({g for _, g in near}) >= self.similar * len(shingles):
                    yield near[0][0], near[-1][0] + size
                    first += len(near)
                else:
                    first += 1


def notices(model: LicenseModel, finder: _Finder, windows: _Windows, text: str, params: LicenseParams) -> list[tuple]:
    """The notices of a text in its order: lines that are classified as one, and windows of blocks
    of lines that are and hold enough of a template. Of windows that overlap the most similar one
    counts; a window within a confirmed line of its family, and an unconfirmed line that touches a
    window of its family, say the same and are left out."""
    lines, more = [], []
    for start, end, words in paragraphs(text):
        hit = classify(model, finder, words, params)
        if hit:
            lines.append((hit[0], start, end, *hit[1:], hit[2] >= params.similar))
    for start, end, words in blocks(text):
        spans, placed = sorted(set(windows(words))), None
        for a, b in spans:
            hit = classify(model, finder, words[a:b], params)
            if hit and hit[2] >= params.similar:
                placed = placed or [m.span() for m in PLACED.finditer(text, start, end)]
                if len(placed) == len(words):
                    more.append((hit[0], placed[a][0], placed[b - 1][1], *hit[1:], True))
                else:  # a letter whose lower case is another one
                    more.append((hit[0], start, end, *hit[1:], True))
    touch = lambda x, y: x[1] < y[2] and y[1] < x[2]
    best: list[tuple] = []
    for w in sorted(more, key=lambda w: (-w[4], w[1], w[0])):
        if not any(touch(w, k) for k in best):
            best.append(w)
    kept = [w for w in best if not any(n[5] and n[0] == w[0] and touch(n, w) for n in lines)]
    lines = [n for n in lines if n[5] or not any(n[0] == k[0] and touch(n, k) for k in kept)]
    return sorted(lines + kept, key=lambda n: (n[1], n[2], n[0]))


def classify(model: LicenseModel, finder: _Finder, words: list[str], params: LicenseParams):
    """Family, probability and similarity of a paragraph, or None if it is of the unknown class.

    The probability is that of the likeliest family against the unknown class."""
    held = finder(words)
    if not held:
        return None
    z = (model.weights[held].sum(axis=0) + model.bias) / model.temperature
    p = _softmax(z[None])[0]
    k = int(p[:-1].argmax())
    sure = float(p[k] / (p[k] + p[-1]))
    if sure < params.least:
        return None
    return model.families[k], sure, similarity(model, model.families[k], words)


FOUND = "array<struct<family string, start int, end int, probability double, similarity double, confirmed boolean>>"


def find_licenses(docs: DataFrame, model: LicenseModel, params: LicenseParams = LicenseParams()) -> DataFrame:
    """``docs`` with ``licenses``: the lines and wrapped passages of each text that are licence notices.

    Entries are in order of the text, with positions in code points, ends exclusive. Whole texts
    are read, see ``notices``. A null or empty text has none; repeated rows are treated alike. A column
    ``licenses`` of ``docs`` is replaced.
    """

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder, windows = _Finder(model.features), _Windows(model, params.similar)
        for texts in batches:
            yield pd.Series([notices(model, finder, windows, text or "", params) for text in texts])

    return docs.withColumn("licenses", find(F.col("text")))
