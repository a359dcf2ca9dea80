"""License notices in texts, retrieved by MinHash bands over overlapping windows.

Texts and templates become lower-case words without punctuation and shingles of ``SHINGLE`` words.
A template belongs to the smallest window size of which it fills three quarters at most; windows of
a size start every quarter of it, so each occurrence lies in one of them as a whole. With at least
``CONTAINED`` of the template's shingles inside, the Jaccard similarity of window and template is at
least ``least_similarity``; ``BANDS`` bands of one row then collide with a probability of
``collision_probability`` (over 0.9999). Shingles that no template has are left out of the windows first, and so are windows
with fewer of the rest than any template of their size needs: that only makes collisions likelier. Exact containment decides, and
of a versioned license every pair of words that ends with a family's name or a version (``telling``)
must be there, too: the members of a family differ in these only. A text too long for a window is several
templates of one number. The templates are a small table of fixed size, and the job is map-only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, joined, mix, rolling, table, text_bytes

SHINGLE, BANDS, CONTAINED = 3, 40, 0.8
SIZES = (8, 16, 32, 64, 128, 256)

#: Standard notices and the texts of short licenses, as published.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
)

#: Words that name a member of a family; of versioned licenses, numbers do, too.
NAMES = frozenset("general lesser affero mit isc apache mpl epl gpl lgpl agpl bsd by nc sa nd attribution sharealike noncommercial noderivatives".split())
VERSIONED = ("GPL", "LGPL", "AGPL", "Apache", "CC-", "CC0", "MPL", "EPL")
WORD = re.compile(r"[^\W_]+")
IDENTIFIER = "SPDX-License-Identifier:"

#: Letters in lower case; ASCII signs that are neither letter nor digit part words.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def telling(name: str, text: str) -> set[tuple[str, str]]:
    """The pairs of words of a template that tell it from others of its family."""
    found = WORD.findall(text.lower())
    number = lambda w: name.startswith(VERSIONED) and re.fullmatch("v?[0-9]+", w)
    clause = lambda w: text.startswith(IDENTIFIER) and re.fullmatch("[0-9]+", w)
    return {(a, b) for a, b in zip(found, found[1:]) if b in NAMES or a == "neither" or number(b) or clause(b)}


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, which of them lie in one text, each text's range of words, and hashes of the pairs of words."""
    data, offsets = text_bytes(column)
    plain = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_PLAIN[data].tobytes()))
    words = Words(plain)
    single = np.r_[words.hashes(), np.zeros(SHINGLE - 1, U64)]
    h, pairs = rolling(single, SHINGLE)[: len(words.starts)], rolling(single, 2)[: len(words.starts)]
    own = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        last = words.bounds[1:] - k
        own[last[(last >= words.bounds[:-1])]] = False
    return h, own, words.bounds, pairs


def size_of(n_words: int) -> int:
    """The window size for a template of so many words."""
    return next((s for s in SIZES if 4 * n_words <= 3 * s), SIZES[-1])


def least_similarity(n_words: int) -> float:
    """The Jaccard similarity that a contained template's window has at least."""
    own = n_words - SHINGLE + 1
    inside = math.ceil(CONTAINED * own - 1e-9)
    return inside / (size_of(n_words) + own - inside)


def collision_probability(similarity: float) -> float:
    return 1 - (1 - similarity) ** BANDS


def _best(rows: list[tuple[int, int, int, int, float]], sizes: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Of occurrences that overlap, the one with most shingles found, then the highest containment: a license's
    header holds its short notice, and three clauses, one of them with another name, hold two."""
    kept: dict[int, list[tuple[int, int, int, int, float]]] = {}
    for row in sorted(rows, key=lambda r: (-round(r[4] * sizes[r[1]]), -r[4], r)):
        own = kept.setdefault(row[0], [])
        if all(row[2] >= o[2] + o[3] or o[2] >= row[2] + row[3] for o in own):
            own.append(row)
    return sorted(r for own in kept.values() for r in own)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        most = 3 * SIZES[-1] // 4
        pieces = [(k, piece) for k, (_, t) in enumerate(templates) for piece in self._cut(t, most)]
        self.origin = [k for k, _ in pieces]
        h, own, bounds, _ = _shingles(pa.array([t for _, t in pieces]))
        self.sets = [np.unique(h[a:b][own[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.words = np.diff(bounds)
        if min(self.words) < SHINGLE:
            raise ValueError(f"templates have {SHINGLE} words at least")
        marks = [sorted(telling(templates[k][0], t)) for k, t in pieces]
        flat = _shingles(pa.array([f"{x} {y}" for m in marks for x, y in m], pa.string()))[3][::2]
        ends = np.cumsum([0, *map(len, marks)])
        self.marks = [np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.by_size = {s: [k for k, n in enumerate(self.words) if size_of(n) == s] for s in SIZES}
        self.seeds = mix(np.arange(1, BANDS + 1, dtype=U64))
        self.least = [np.array([mix(x ^ seed).min() for x in self.sets]) for seed in self.seeds]
        self.every = np.unique(np.concatenate(self.sets))
        self.maybe = np.zeros(1 << 20, bool)  # by the lowest bits, whether a shingle can be any template's
        self.maybe[self.every & U64(0xFFFFF)] = True
        self.fewest = {s: min((math.ceil(CONTAINED * len(self.sets[k]) - 1e-9) for k in some), default=0) for s, some in self.by_size.items()}

    @staticmethod
    def _cut(text: str, most: int) -> list[str]:
        """The text, or pieces of about equal length if it has more than ``most`` words."""
        at = [m.start() for m in WORD.finditer(text)]
        n = max(1, -(-len(at) // most))
        cuts = [at[len(at) * k // n] for k in range(1, n)]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def scan(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, words, containment) of all occurrences."""
        h, own, bounds, pairs = _shingles(column)
        near: set[tuple[int, int, int]] = set()
        # shingles that no template has can't be the least of a template, so windows are sketched by the others
        places = np.flatnonzero(self.maybe[h & U64(0xFFFFF)] & own)
        places = places[np.isin(h[places], self.every)]
        for size, some in self.by_size.items():
            if not some or not len(places):
                continue
            quarter = places // (size // 4)
            window = (quarter[:, None] - np.arange(4)).ravel()  # a shingle lies in four windows
            order = np.argsort(window, kind="stable")
            order = order[window[order] >= 0]
            first = np.flatnonzero(np.r_[True, np.diff(window[order]) != 0])
            enough = np.repeat(counts := np.diff(np.r_[first, len(order)]), counts) >= self.fewest[size]
            order = order[enough]
            if not len(order):
                continue
            first = np.flatnonzero(np.r_[True, np.diff(window[order]) != 0])
            starts, values = window[order][first], h[places[order // 4]]
            for seed, least in zip(self.seeds, self.least, strict=True):
                low, goals = np.minimum.reduceat(mix(values ^ seed), first), least[some]
                for w in np.flatnonzero(np.isin(low, goals)).tolist():
                    near.update((int(starts[w]), size, some[k]) for k in np.flatnonzero(goals == low[w]).tolist())
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for at, size, k in near:
            a, b = at * size // 4, min(at * size // 4 + size, len(h))
            inside = np.flatnonzero(np.isin(h[a:b], self.sets[k]) & own[a:b]) + a
            for text in np.unique(np.searchsorted(bounds, inside, side="right") - 1).tolist():
                hits = inside[(inside >= bounds[text]) & (inside < bounds[text + 1])]
                share = len(np.unique(h[hits])) / len(self.sets[k])
                if share >= CONTAINED and np.isin(self.marks[k], pairs[hits[0] : hits[-1] + SHINGLE - 1]).all():
                    found.setdefault((text, k), []).append((int(hits[0] - bounds[text]), int(hits[-1] + SHINGLE - bounds[text]), share))
        out = []
        for (text, k), spans in found.items():
            first, end, best = -1, -1, 0.0
            for a, b, share in sorted(spans):
                if a < end:
                    end, best = max(end, b), max(best, share)
                    continue
                if end >= 0:
                    out.append((text, k, first, end - first, best))
                first, end, best = a, b, share
            out.append((text, k, first, end - first, best))
        return [(t, self.origin[k], *rest) for t, k, *rest in _best(out, [len(x) for x in self.sets])]


def from_table(rows: DataFrame, name_col: str = "license", text_col: str = "text", most: int = 20_000) -> tuple[tuple[str, str], ...]:
    """Templates from a table, in the order of name and text; nulls and texts too short for a shingle are left out.

    Every task holds all templates, so a table of more than ``most`` rows is refused."""
    found = rows.select(F.col(name_col).alias("n"), F.col(text_col).alias("t")).filter("n IS NOT NULL AND t IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} templates")
    return tuple(sorted((r["n"], r["t"]) for r in found if len(WORD.findall(r["t"])) >= SHINGLE))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each occurrence of a template: id, license, template number, first word and number of
    words (lower-case words without punctuation count), containment of its shingles.

    Overlapping windows that hold the same template make one occurrence; of overlapping occurrences of
    several templates, the best stays. Null, empty and short texts have none; very long ones are scanned whole. Ids may be
    null; repeated rows give repeated results. Other columns, whatever their names, are not read. An empty table gives
    an empty table.
    """
    names = [n for n, _ in templates]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in joined(batches):
            rows = known.scan(batch["text"])
            cols = [batch[id_col].take(pa.array([r[0] for r in rows], pa.int64())), pa.array([names[r[1]] for r in rows], pa.string())]
            cols += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "license", "template", "first_word", "n_words", "containment"])

    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, license string, template int, first_word long, n_words long, containment double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
