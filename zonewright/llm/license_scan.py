"""Operator 1: licence scan by Dice coefficient over word bigrams.

A text is normalised (A-Z in lower case, ASCII characters other than letters and digits become space) to one row of words. A window slides over
it for each template, wherever the template's bigrams are dense: windows begin and end with one of them, whatever lines or sentences they
lie in, so that a licence is found inside a sentence, on one line or over many, beside another one or with list numbers on its lines. A window and a template of a and b bigrams can reach a Dice coefficient of t only if the
smaller count is at least t / (2 - t) of the larger: that bounds the windows of a template, and how many of its bigrams such a window must have,
so that a start is passed over by one look at where as many bigrams on would end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

#: Notices and short texts of public licences, each under its usual identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_PLAIN = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 or b == 10 else 32 for b in range(256))
_UNIT_END = re.compile(rb"(?<=[.!?])[ \t\r\f\v]+")


def units_of(raw: bytes) -> list[list[bytes]]:
    """Words of each unit that has any, in order."""
    plain = _UNIT_END.sub(b"\n", raw).lower().translate(_PLAIN)
    return [w for w in (x.split() for x in plain.split(b"\n")) if w]


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter, size_a: int, size_b: int) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return 2 * sum(min(n, large[g]) for g, n in small.items() if g in large) / (size_a + size_b)


class Templates:
    """Templates by number of bigrams, and the bigrams that lead to them."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold, self.bound = threshold, threshold / (2 - threshold)
        self.items = []
        self.by_bigram: dict[tuple, set[int]] = {}
        for name, text in templates:
            words = [w for u in units_of(text.encode()) for w in u]
            grams = bigrams(words)
            if not grams:
                continue
            for g in grams:
                self.by_bigram.setdefault(g, set()).add(len(self.items))
            self.items.append((name, grams, sum(grams.values())))
        self.words = {w for g in self.by_bigram for w in g}
        sizes = [n for _, _, n in self.items]
        self.least, self.most = min(sizes, default=1) * self.bound, max(sizes, default=0) / self.bound

    def best(self, words: list[bytes], among: set[int]) -> tuple[float, str] | None:
        """The template of highest coefficient at or over the threshold, by name among equals."""
        n, found = len(words) - 1, None
        if not self.least <= n <= self.most:
            return None
        grams = None
        for k in sorted(among):
            name, other, m = self.items[k]
            if min(n, m) < self.bound * max(n, m):
                continue
            grams = bigrams(words) if grams is None else grams
            d = dice(grams, other, n, m)
            if d >= self.threshold and (found is None or (-d, name) < (-found[0], found[1])):
                found = d, name
        return found

    def windows(self, grams: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int, float, str]]:
        """For each template and start the window of highest coefficient at or over the threshold, the longest among equals: (first word, end word, coefficient, name)."""
        hits: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            if g in self.by_bigram:
                for k in self.by_bigram[g]:
                    hits.setdefault(k, []).append(i)
        for k, at in hits.items():
            name, other, m = self.items[k]
            widest = int(m / self.bound + 1e-9)
            fewest = ceil(self.threshold * (ceil(m * self.bound - 1e-9) + m) / 2 - 1e-9)  # in common, by the shortest window
            for j in range(len(at) - fewest + 1):
                first = at[j]
                if at[j + fewest - 1] - first >= widest:
                    continue
                left, both, top = dict(other), 0, None
                for i in at[j : j + widest]:
                    n = i - first + 1
                    if n > widest or (top and 2 * m < top[2] * (n + m)):  # nothing longer reaches as much
                        break
                    if left[grams[i]]:
                        left[grams[i]] -= 1
                        both += 1
                        if (d := 2 * both / (n + m)) >= self.threshold and (top is None or d >= top[2]):
                            top = first, i + 2, d, name
                if top:
                    yield top

    def scan(self, raw: bytes) -> list[tuple[int, int, float, str]]:
        """Windows that match, as (first word, end word, coefficient, name), best first; a window that overlaps a better one is left out."""
        words = [w for u in units_of(raw) for w in u]
        out: list[tuple[int, int, float, str]] = []
        kept: list[tuple[int, int]] = []  # in order, without overlaps
        for x in sorted(self.windows(list(zip(words, words[1:], strict=False))), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
            k = bisect_left(kept, (x[0], x[1]))
            if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
                insort(kept, (x[0], x[1]))
                out.append(x)
        return out


@cache
def compiled(templates: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    return Templates(templates, threshold)


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Each row of docs with doc_id, licence and dice of its best match (null if none), licences (sorted, distinct) and blocks.

    docs: doc_id (of any type) and text; other columns are ignored. blocks: first word, end word (exclusive), coefficient and name of
    each match; matches do not overlap. Equal coefficients: the longer block, then the earlier, then the first name. Time grows with the text and its matches, not with their square. A null
    or empty text has no match. Repeated rows and null ids come back one for one. Neither documents nor matches are moved
    between tasks; the templates are a parameter and travel with the code.
    """
    block = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("dice", pa.float64()), ("licence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compiled(templates, threshold)
        for b in batches:
            hits = [known.scan(t.as_py() or b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h[0][3] if h else None for h in hits], pa.string()),
                    pa.array([h[0][2] if h else None for h in hits], pa.float64()),
                    pa.array([sorted({x[3] for x in h}) for h in hits], pa.list_(pa.string())),
                    pa.array([[dict(zip(("first", "end", "dice", "licence"), x, strict=True)) for x in sorted(h)] for h in hits], pa.list_(block)),
                ],
                ["doc_id", "licence", "dice", "licences", "blocks"],
            )

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {id_type(docs)}, licence string, dice double, licences array<string>, blocks array<struct<first: int, end: int, dice: double, licence: string>>")
