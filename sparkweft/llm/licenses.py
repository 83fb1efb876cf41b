"""Licence notices in texts, by Dice coefficient over word bigrams.

Texts and templates are normalised to words of letters and digits in lower case. The places of each
template's own bigrams in a text form runs of that template, and the best window of a run is compared
with it. For sizes a and b, Dice is at most 2 min(a, b) / (a + b), so a window holds between
b t / (2 - t) and b (2 - t) / t different bigrams, at least b t / (2 - t) of them the template's, and at
most 2 b (1 / t - 1) others: a run ends where more lie between two of its bigrams, and one with too
few is no passage. Of windows that overlap, the one that explains most of the text stays.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: The least coefficient.
LEAST = 0.8

# Notices and texts of public licences.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}
# The full texts, a file each, named by the licence.
for _text in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    TEMPLATES.setdefault(_text.stem, []).append(_text.read_text(encoding="utf-8"))


def _pairs(h: np.ndarray) -> np.ndarray:
    return hashing.mix(h[:-1] * np.uint64(3) + h[1:])


class Templates:
    def __init__(self, texts: dict[str, list[str]], least: float):
        self.least = least
        self.sets = [(name, frozenset(_pairs(hashing.words(t.encode(), hashing.WORDS)[2]).tolist())) for name in sorted(texts) for t in texts[name]]
        self.sets = [x for x in self.sets if x[1]]
        self.sizes = [len(s) for _, s in self.sets]
        #: The fewest bigrams that a passage shares with a template, the most that it holds, and the most others in it.
        self.fewest = np.array([math.ceil(b * least / (2 - least) - 1e-9) for b in self.sizes])
        self.most = [int(b * (2 - least) / least + 1e-9) for b in self.sizes]
        self.others = [int(2 * b * (1 / least - 1) + 1e-9) for b in self.sizes]
        known = np.array(sorted(set().union(*(s for _, s in self.sets))), np.uint64)
        self.known = known if len(known) else np.zeros(1, np.uint64)
        #: The templates of each known bigram, one after another, and where each one's begin.
        entries = sorted((x, k) for k, (_, s) in enumerate(self.sets) for x in s)
        self.of = np.array([k for _, k in entries], np.int64)
        self.begin = np.searchsorted(np.array([x for x, _ in entries], np.uint64), np.append(self.known, self.known[-1:]), "left")
        self.begin[-1] = len(entries)
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, pairs: np.ndarray) -> np.ndarray:
        """Which bigrams are in some template."""
        maybe = np.flatnonzero(self.mask[(pairs & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, pairs[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == pairs[maybe]]

    def notices(self, pairs: np.ndarray, at: np.ndarray) -> list[tuple[float, str, int, int]]:
        """Coefficient, name, first and last bigram of each notice, in order; at: the places of templates' bigrams."""
        known = np.searchsorted(self.known, pairs[at])
        n = self.begin[known + 1] - self.begin[known]
        of = self.of[np.repeat(self.begin[known] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        places = np.repeat(at, n)
        found: list[tuple[float, str, int, int, int]] = []
        for k in np.flatnonzero(np.bincount(of, minlength=len(self.sets)) >= self.fewest).tolist():
            own = places[of == k]
            if len(own):
                breaks = np.flatnonzero(np.diff(own) > self.others[k] + 1) + 1
                for run in np.split(own, breaks):
                    found += self._windows(k, pairs, run)
        # Most bigrams shared, weighed by the coefficient; of equals the name that sorts first, then the first place.
        found.sort(key=lambda x: (-x[4] * x[0], x[1], x[2]))
        kept: list[tuple[float, str, int, int]] = []
        for dice, name, a, b, _ in found:
            if all(b + 1 < c or d + 1 < a for _, _, c, d in kept):  # a bigram's second word is the next one's first
                kept.append((dice, name, a, b))
        return sorted(kept, key=lambda x: x[2])

    def _windows(self, k: int, pairs: np.ndarray, run: np.ndarray) -> list[tuple[float, str, int, int, int]]:
        """The best window of a run, and those of what lies before and behind it."""
        out, todo = [], [run]
        while todo:
            run = todo.pop()
            best = self._best(k, pairs, run) if len(run) >= self.fewest[k] else None
            if best:
                out.append((best[0], self.sets[k][0], *best[1:]))
                todo += [run[run < best[1] - 1], run[run > best[2] + 1]]
        return out

    def _best(self, k: int, pairs: np.ndarray, run: np.ndarray) -> tuple[float, int, int, int] | None:
        """Coefficient, first and last bigram and bigrams shared of the best window that begins and ends in the run."""
        low, b, best = int(run[0]), self.sizes[k], None
        line = pairs[low : int(run[-1]) + 1]
        order = np.argsort(line, kind="stable")
        before = np.full(len(line), -1)  # where the same bigram stood last
        same = line[order[1:]] == line[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        mine = np.zeros(len(line), bool)
        mine[run - low] = True
        for start in (run - low).tolist():
            # As far as the window can hold different bigrams: the first part, doubled until it is too large.
            width = 2 * self.most[k]
            while True:
                fresh = before[start : start + width] < start
                size = np.cumsum(fresh)
                if size[-1] > self.most[k] or start + width >= len(line):
                    break
                width *= 2
            inside = mine[start : start + len(size)]
            shared = np.cumsum(fresh & inside)
            if shared[-1] < self.fewest[k]:
                continue
            dice = np.where(inside, 2 * shared / (size + b), 0.0)
            end = int(np.argmax(dice))
            if dice[end] >= self.least and (best is None or dice[end] > best[0]):
                best = float(dice[end]), low + start, low + start + end, int(shared[end])
                if best[0] == 1:
                    break
        return best


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """docs with `licences`: licence, dice, start and end (code points) of each notice, in order.

    Null and empty texts have none. Rows are judged one by one, so repeated rows and null ids are no
    matter; an empty table stays empty; a column named licences gives way.
    """
    given = templates or TEMPLATES
    built: list[Templates] = []

    def work(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Templates(given, least))
        known, out = built[0], [[] for _ in range(len(texts))]
        for begin, line, ends in hashing.runs(texts):
            starts, stops, h = hashing.words(line, hashing.WORDS)
            if len(h) < 2:
                continue
            pairs = _pairs(h)
            hit = known.hits(pairs)
            doc = np.searchsorted(ends, starts, "right")
            hit = hit[doc[hit] == doc[hit + 1]]
            bounds = np.searchsorted(doc[hit], np.arange(len(ends) + 1))
            for i in np.unique(doc[hit]).tolist():
                low, raw = (int(ends[i - 1]) if i else 0), line
                place = lambda x: int(((raw[low:x] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                for dice, name, a, b in known.notices(pairs, hit[bounds[i] : bounds[i + 1]]):
                    out[begin + i].append({"licence": name, "dice": dice, "start": place(int(starts[a])), "end": place(int(stops[b + 1]))})
        return pa.array(out, KIND)

    return common.append(docs, "licences", KIND, "array<struct<licence:string,dice:double,start:long,end:long>>", work)


KIND = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def op1_licenses(spark, sf_dir):
    """The best notice of each document (the first of equals), and how many it has."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.aggregate("licences", F.lit(None).cast("struct<licence:string,dice:double,start:long,end:long>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_notices"), best.alias("best")).select("doc_id", "n_notices", "best.licence", "best.dice", "best.start", "best.end")
