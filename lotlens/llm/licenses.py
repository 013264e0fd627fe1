"""License scan: MinHash bands over text windows retrieve templates, shingle containment verifies.

Words are runs of letters, digits and underscores, lower-cased; shingles are five words. For each template length
there is a grid of overlapping windows of that many shingles, a step of at most an eighth apart, so some window is off by a
sixteenth at most. A window or template has ``ROWS * BANDS`` MinHash values; a template is retrieved if a band agrees.
For a window that holds ``CONTAINMENT`` of a template the Jaccard likeness is ``least_jaccard`` or more,
and ``retrieval_probability`` (above 0.9999 for these settings) is the chance to retrieve it. Verification counts the template's
distinct shingles inside the window widened by one step, exactly.

A window without a shingle of any template can share no MinHash value with one, so values are computed only for
windows that hold one; this skips work, not cases.

Defined results: null text has no words; one row per document and template, at the best place (the first of
equals); templates with fewer than five words are one shingle of all their words; equal templates are reported each; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 40, 2
STEPS = 8
_WORD = re.compile(r"\w+")
MATCHES = "doc_id long, license string, first_word long, n_words long, containment double"

# Public license notices and their SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def least_jaccard(containment: float = CONTAINMENT, steps: int = STEPS) -> float:
    """Of a template with a window of its length that is off by half a step and holds this share of it."""
    shared = containment * (1 - 0.5 / steps)
    return shared / (2 - shared)


def retrieval_probability(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - jaccard**rows) ** bands


class Index:
    """Templates with their shingles, MinHash bands and the windows that fit their lengths."""

    def __init__(self, templates: list[tuple[str, str]], containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS):
        self.containment, self.bands, self.rows = containment, bands, rows
        draw = np.random.default_rng(20_240_501)
        self.factors = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.code: dict[str, int] = {}
        self.templates, self.lengths = [], defaultdict(list)
        self.buckets: dict[tuple, list[int]] = defaultdict(list)
        for name, text in templates:
            found = words(text)
            if not found:
                continue
            self.code.update((w, self._word(w)) for w in found)
            hashes = self._shingles([self._word(w) for w in found], min(SHINGLE, len(found)))
            number = len(self.templates)
            self.templates.append((name, set(hashes.tolist()), len(found)))
            self.lengths[min(SHINGLE, len(found)), len(hashes)].append(number)
            for key in self._bands(hashes):
                self.buckets[len(hashes), *key].append(number)
        self.known = {k: np.unique(np.array([h for n in {n for (size, _), ns in self.lengths.items() if size == k for n in ns} for h in self.templates[n][1]], dtype=np.uint64)) for k in {size for size, _ in self.lengths}}

    @staticmethod
    def _word(word: str) -> int:
        return xxhash.xxh64_intdigest(word, 11)

    @staticmethod
    def _mixed(columns: np.ndarray | list[np.ndarray]) -> np.ndarray:
        """Hashes of shingles given as one array per place."""
        out = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _shingles(self, codes: list[int], size: int) -> np.ndarray:
        values = np.array(codes, dtype=np.uint64)
        count = len(values) - size + 1
        return self._mixed([values[i : i + count] for i in range(size)]) if count > 0 else np.zeros(0, np.uint64)

    def _bands(self, hashes: np.ndarray) -> Iterator[tuple]:
        mixed = hashes[:, None] * self.factors[None, :] + self.terms[None, :]
        least = (mixed ^ (mixed >> np.uint64(31))).min(0).reshape(self.bands, self.rows).tolist()
        return ((band, *values) for band, values in enumerate(least))

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, words, containment) of each template found, at its best window."""
        found = words(text)
        get = self.code.get
        marks = np.array([get(w, 0) for w in found], dtype=np.uint64)
        best: dict[int, tuple[float, int, int]] = {}
        for (size, length), numbers in self.lengths.items():
            if len(marks) < size:
                continue
            zero = np.concatenate([[0], np.cumsum(marks == 0)])
            full = np.flatnonzero(zero[size:] == zero[:-size])
            if not len(full):
                continue
            parts = np.stack([marks[full + i] for i in range(size)], 1)
            hits = full[np.isin(self._mixed(parts.T), self.known[size])]
            if not len(hits):
                continue
            step, last = max(1, length // STEPS), max(0, len(found) - size + 1 - length)
            starts = {min(last, s * step) for h in hits.tolist() for s in range(max(0, (h - length) // step + 1), h // step + 1)}
            for start in sorted(starts):
                window = self._shingles([get(w) or self._word(w) for w in found[start : start + length + size - 1]], size)
                retrieved = {n for key in self._bands(window) for n in self.buckets.get((length, *key), ())} & set(numbers)
                if not retrieved:
                    continue
                low, high = max(0, start - step), start + length + size - 1 + step
                around = set(self._shingles([get(w) or self._word(w) for w in found[low:high]], size).tolist())
                for number in retrieved:
                    name, shingles, n_words = self.templates[number]
                    share = len(shingles & around) / len(shingles)
                    if share >= self.containment and (number not in best or share > best[number][0]):
                        best[number] = share, start, n_words
        return [(self.templates[n][0], start, size, share) for n, (share, start, size) in sorted(best.items())]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: place and containment of the best template of the license."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, containment))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best: dict[str, tuple] = {}
                for name, start, size, share in index.value.matches(text):
                    if name not in best or (share, size, -start) > (best[name][2], best[name][1], -best[name][0]):
                        best[name] = start, size, share
                out += [(doc_id, name, *place) for name, place in sorted(best.items())]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return rows.mapInArrow(find, MATCHES)
