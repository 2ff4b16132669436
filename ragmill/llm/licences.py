"""Licence scans: stretches of lines compared to licence templates by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, everything but letters and digits becomes a space,
copyright lines go. A stretch is one or more whole lines that follow each other; the whole text is one too.
Where no stretch of whole lines reaches THRESHOLD, any run of words is one, so a licence may share its lines
with other prose, or with a copyright line.
A stretch that reaches THRESHOLD shares enough bigrams with the template to hold one of its key bigrams (all
but so many that the rest could not suffice alone), so lines are first probed for those. Around a probe hit,
only stretches within the size bounds that the threshold sets for the template are compared.

Defined cases: null and empty texts match nothing; a template found twice in one text gives one row, for its
best and then first stretch; equal rows give equal rows; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

THRESHOLD = 0.8

# The notices and short texts of common licences, as published.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "MIT notice 3": "This project is licensed under the terms of the MIT license.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-2.0 with URL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1 with URL": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have
received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0 long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}

_NOT_WORD = re.compile(r"[\W_]+")
_COPYRIGHT = re.compile(r"(?im)^\W*(?:copyright\b|\(c\)|©).*$")


def normalised(text: str) -> list[str]:
    return _NOT_WORD.sub(" ", text.lower()).split()


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = {name: bigrams(normalised(_COPYRIGHT.sub("", text))) for name, text in templates.items()}
        self.templates = {name: b for name, b in self.templates.items() if b}
        spread: dict[tuple[str, str], int] = {}
        for b in self.templates.values():
            for x in b:
                spread[x] = spread.get(x, 0) + 1
        self.keys: dict[tuple[str, str], list[str]] = {}
        self.bounds: dict[str, tuple[int, int]] = {}
        for name, b in self.templates.items():
            # Dice >= t with sizes x and n needs t * n / (2 - t) <= x <= n * (2 - t) / t, and as many shared as the lower bound.
            low, high = math.ceil(threshold * len(b) / (2 - threshold) - 1e-9), math.floor(len(b) * (2 - threshold) / threshold + 1e-9)
            self.bounds[name] = low, high
            # Bigrams of longer words first: function words, which any prose holds, are left out.
            ranked = sorted(b, key=lambda x: (-min(len(x[0]), len(x[1])), -len(x[0]) - len(x[1]), spread[x], x))
            for x in ranked[: len(b) - low + 1]:
                self.keys.setdefault(x, []).append(name)
        firsts: dict[str, set[str]] = {}
        for a, b in self.keys:
            firsts.setdefault(a, set()).add(b)
        self.probe = re.compile(r"(?<![^\W_])(?:" + "|".join(rf"{a}[\W_]+(?:{'|'.join(sorted(bs))})" for a, bs in sorted(firsts.items())) + r")(?![^\W_])")

    def best_run(self, grams: list[tuple[tuple[str, str], int, int]], name: str) -> tuple[float, int, int] | None:
        """(Dice, first line, last line) of a template's best and then first run of words, given as bigrams with their lines.

        A best run begins and ends with bigrams of the template, and its first one doesn't come again in it. One
        with more than 2n (1 - t) / t bigrams that the template lacks can't reach the threshold t.
        """
        template = self.templates[name]
        n, foreign = len(template), 2 * len(template) * (1 - self.threshold) / self.threshold + 1e-9
        best = None
        for start, (head, first, _) in enumerate(grams):
            if head not in template:
                continue
            held: set[tuple[str, str]] = set()
            shared = 0
            for k in range(start, len(grams)):
                x, _, last = grams[k]
                if x in held:
                    if x == head:
                        break
                    continue
                held.add(x)
                if x in template:
                    shared += 1
                    score = 2 * shared / (len(held) + n)
                    if score >= self.threshold and (best is None or score > best[0]):
                        best = score, first, last
                elif len(held) - shared > foreign:
                    break
        return best

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first line, last line) of each template's best stretch that no liker one overlaps."""
        lowered = text.lower()
        if not self.probe.search(lowered):
            return []
        raw = text.split("\n")
        lines = [[] if _COPYRIGHT.match(x) else normalised(x) for x in raw]
        # A line's bigrams, with the one that leads into it from the last line with words.
        own: list[set[tuple[str, str]]] = []
        into: list[tuple[str, str] | None] = []
        last = None
        for words in lines:
            own.append(set(bigrams(words)))
            into.append((last, words[0]) if last and words else None)
            last = words[-1] if words else last
        hit: dict[str, set[int]] = {}
        for i in range(len(lines)):
            for x in own[i] | ({into[i]} if into[i] else set()):
                for name in self.keys.get(x, ()):
                    hit.setdefault(name, set()).add(i)
        # Words with their lines, for runs of words. A copyright line that holds a key bigram holds more than its notice.
        flat = []
        for i, words in enumerate(lines):
            if not words and _COPYRIGHT.match(raw[i]):
                words = normalised(raw[i])
                words = words if any(x in self.keys for x in bigrams(words)) else []
            flat += [(w, i) for w in words]
        grams = [((a, b), i, j) for (a, i), (b, j) in zip(flat, flat[1:], strict=False)]
        for x, _, j in grams:
            for name in self.keys.get(x, ()):
                hit.setdefault(name, set()).add(j)
        out = []
        likeness: dict[str, float] = {}
        for name, at in sorted(hit.items()):
            template, (low, high) = self.templates[name], self.bounds[name]
            best = None
            starts = set()
            for i in at:  # stretches that hold line i
                j = i
                starts.add(i)
                # Lines repeat bigrams, so a stretch's set may be smaller than its sum; go back while the set fits.
                # Once the lines before hold all that line i brings, one of them is a hit and goes further back.
                held = set(own[i])
                brought = own[i] | ({into[i]} if into[i] else set())
                while j > 0 and brought:
                    if into[j]:
                        held.add(into[j])
                    held |= own[j - 1]
                    brought = brought - own[j - 1] - ({into[j]} if j < i else set())
                    j -= 1
                    if len(held) > high:
                        break
                    starts.add(j)
            for start in sorted(starts):
                held = set(own[start])
                end, scored = start, -1
                # What the first line brings; once later lines hold it too, the stretch without that line is as good.
                brought = own[start] | ({into[start + 1]} if start + 1 < len(lines) and into[start + 1] else set())
                while True:
                    if low <= len(held) <= high and len(held) != scored:
                        scored = len(held)
                        score = dice(frozenset(held), template)
                        if score >= self.threshold and (best is None or score > best[0]):
                            best = score, start, end
                    end += 1
                    if len(held) > high or end == len(lines):
                        break
                    if into[end]:
                        held.add(into[end])
                    held |= own[end]
                    brought = brought - own[end] - ({into[end]} if end > start + 1 else set())
                    if not brought:
                        break
            run = None if best and best[0] == 1 else self.best_run(grams, name)
            if best and run and run[0] > best[0] and run[1] <= best[2] and best[1] <= run[2]:
                # Whole lines may hold prose that runs leave out, so templates are compared by their runs.
                likeness[name] = run[0]
                if run[1] < best[1] or best[2] < run[2]:
                    best = run
            best = best or run
            if best:
                out.append((name, best[0], best[1], best[2]))
        # Of templates whose stretches overlap, the likest stays, of equally like ones the longest.
        kept: list[tuple[str, float, int, int]] = []
        for x in sorted(out, key=lambda x: (-likeness.get(x[0], x[1]), -len(self.templates[x[0]]), x[0])):
            if not any(x[2] <= y[3] and y[2] <= x[3] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[2], x[0]))


@functools.cache
def scanner(threshold: float) -> Scanner:
    return Scanner(TEMPLATES, threshold)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and template that it holds: doc_id, template, dice, first_line, last_line (from 0)."""
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(threshold).scan
        for group in common.groups(batches):
            ids = group.column(0).to_pylist()
            rows = [(i, *hit) for i, text in zip(ids, group.column(1).to_pylist(), strict=True) if text for hit in find(text)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "template": pa.array([r[1] for r in rows], pa.string()),
                    "dice": pa.array([r[2] for r in rows], pa.float64()),
                    "first_line": pa.array([r[3] for r in rows], pa.int64()),
                    "last_line": pa.array([r[4] for r in rows], pa.int64()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, template string, dice double, first_line long, last_line long")
