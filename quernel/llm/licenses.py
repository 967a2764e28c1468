"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Words are runs of letters, digits and characters beyond ASCII, in lower case; shingles are five
words. A template of t shingles is sought in windows that overlap so that any place where it may
stand lies within one; windows follow the template's length, so where three quarters of it stand,
window and template have a Jaccard similarity of 0.41 or more, and the 32 bands of one hash miss it
with a probability below 1e-7. A window that meets a template in any band is verified: the
containment of the template's shingles in it must be 0.75 or more. A template of fewer than five
words is sought as a whole, in windows of its own length, and must stand there word for word.

One row for each document, in any order: rows that repeat an id, or have none, are taken one by one,
and an empty table gives no rows. Null and empty texts match nothing, and those of fewer than five
words only templates that are as short. Very long texts go through in segments that overlap by twice
the longest template; extra columns are not read. Of several windows the fullest, then the first, stands for a template; of several
templates the fullest, then the longest, then the first by name, is the best. Templates are
broadcast with the code: their number is bounded by MOST_TEMPLATES, and more are refused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import id_text, raw, ship, tidy
from quernel.llm.textkernel import _mark, shingles, word_hashes

BANDS, THRESHOLD, WIDTH = 32, 0.75, 5
MOST_TEMPLATES = 5000
SEGMENT = 1 << 16

#: Notices of common licenses, as their texts have them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved-line": "No part of this publication may be reproduced without the prior written permission of the publisher.",
    "all-rights-reserved": "All rights reserved.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_rng = np.random.default_rng(20240607)
_FACTORS = (_rng.integers(1 << 31, size=BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_OFFSETS = (np.arange(BANDS, dtype=np.int32) << 16)[:, None]


def _rows(h: np.ndarray) -> np.ndarray:
    """The bands' hashes of shingles, (bands, shingles): odd multiples, hence permutations."""
    return (h >> np.uint64(32)).astype(np.uint32)[None, :] * _FACTORS


class _Class:
    """Templates sought in windows of the same shape: count blocks of step shingles."""

    def __init__(self, most: int):
        self.step = max(1, most // 4)
        self.count = -(-(most + self.step - 1) // self.step)
        self.width = self.count * self.step

    def meeting(self, row: np.ndarray, i: int) -> list[int]:
        """Windows whose least hash in a band is the one at i."""
        last = max(0, -(-len(row) // self.step) - self.count)
        lo = max(0, -(-(i - self.width + 1) // self.step))
        return [w for w in range(min(lo, last), min(i // self.step, last) + 1) if row[w * self.step : w * self.step + self.width].min() == row[i]]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"at most {MOST_TEMPLATES} templates")
        self.names = sorted(templates)
        self.sets, self.classes, self.class_of, self.length = [], {}, [], []
        # Of templates below WIDTH words: by width, and by the hash of the whole, their words.
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = defaultdict(lambda: defaultdict(list))
        self.filter = np.zeros(BANDS << 16, bool)
        self.at: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, name in enumerate(self.names):
            words = word_hashes(templates[name].encode(), _mark)
            if not len(words):
                raise ValueError(f"no words in template {name}")
            h = shingles(words, min(WIDTH, len(words)))
            self.sets.append(np.unique(h))
            self.length.append(len(self.sets[j]) + min(0, len(words) - WIDTH))
            if len(words) < WIDTH:
                self.class_of.append(None)
                self.short[len(words)][int(h[0])].append((j, words))
                continue
            t = most = len(h)
            if t > 7:  # lengths within a quarter share their windows
                most = 8
                while most < t:
                    most = most * 5 // 4
            if most not in self.classes:
                self.classes[most] = _Class(most)
            self.class_of.append(self.classes[most])
            for band, v in enumerate(_rows(h).min(axis=1).tolist()):
                self.filter[(band << 16) + (v & 0xFFFF)] = True
                self.at[band, v].append(j)
        self.longest = max(self.classes, default=1) * 2

    def candidates(self, rows: np.ndarray) -> set[tuple[int, int]]:
        """(window, template) with the same least hash in some band.

        Places that hold a template's least hash are found first, for all templates at once.
        """
        found = set()
        places = np.flatnonzero(self.filter.take((rows & np.uint32(0xFFFF)).view(np.int32) + _OFFSETS))
        for band, i in zip(*(x.tolist() for x in np.divmod(places, rows.shape[1]))):
            for j in self.at.get((band, int(rows[band, i])), ()):
                found.update((w, j) for w in self.class_of[j].meeting(rows[band], i))
        return found

    def whole(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """The first place of each template below WIDTH words."""
        found = {}
        for width, known in self.short.items():
            if len(words) < width:
                continue
            h = shingles(words, width)
            for i in np.flatnonzero(np.isin(h, np.array([*known], np.uint64))).tolist():
                for j, t in known[int(h[i])]:
                    if j not in found and np.array_equal(words[i : i + width], t):
                        found[j] = (-1.0, i, width)
        return found

    def scan(self, data: memoryview | bytes) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, words) of each template found."""
        words = word_hashes(data, _mark)
        best = self.whole(words)
        h = shingles(words, WIDTH) if len(words) >= WIDTH else words[:0]
        for at in range(0, len(h), SEGMENT):
            part = h[at : at + SEGMENT + self.longest]
            for w, j in self.candidates(_rows(part)):
                c, t = self.class_of[j], self.sets[j]
                lo = w * c.step
                window = part[lo : lo + c.width]
                inside = np.isin(window, t)
                share = len(np.unique(window[inside])) / len(t)
                if share >= THRESHOLD:
                    where = np.flatnonzero(inside)
                    key = (-share, at + lo + int(where[0]), int(where[-1] - where[0]) + WIDTH)
                    if j not in best or key < best[j]:
                        best[j] = key
        return [(j, -k[0], k[1], k[2]) for j, k in sorted(best.items())]


def templates(table: DataFrame, name: str = "name", text: str = "text") -> dict[str, str]:
    """A table's templates, as scan takes them, of full license texts for instance. At most
    MOST_TEMPLATES: they are held by each worker; more are refused, and may be scanned in several runs."""
    rows = table.select(F.col(name).alias("name"), F.col(text).alias("text")).limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    out = {r["name"]: r["text"] for r in rows}
    if len(out) < len(rows):
        raise ValueError("a name has two texts")
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_matches, best_template, best_containment, matches) for each document."""
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.scan(t) for t in raw(batch.column(1))]
            best = [max(f, key=lambda x: (x[1], scanner.length[x[0]], -x[0]), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([scanner.names[b[0]] if b else None for b in best], pa.string()), pa.array([b[1] if b else None for b in best], pa.float64()), pa.array([[{"template": scanner.names[j], "containment": c, "first_word": a, "n_words": n} for j, c, a, n in f] for f in found], kind)],
                ["doc_id", "n_matches", "best_template", "best_containment", "matches"],
            )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_matches int, best_template string, best_containment double, matches array<struct<template: string, containment: double, first_word: long, n_words: long>>")
