"""License texts in documents by patience alignment with templates."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_text
from .tokens import word_blocks

#: Share of a template's words that an alignment must cover, for templates under and from SHORT words; words of text
#: that an alignment may stretch over, as a multiple of the template's.
COVER_SHORT, COVER_LONG, SHORT, STRETCH = 0.9, 0.75, 20, 1.5

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Proprietary-notice": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
        Public License for more details. You should have received a copy of the GNU Lesser General Public License along with
        this library. If not, see <https://www.gnu.org/licenses/>.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this
        entire statement, including the above license grant, this restriction and the following disclaimer, must be included
        in all copies of the Software, in whole or in part, and all derivative works of the Software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
        IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software.""",
}


def longest_increasing(x: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], [-1] * len(x)
    for k, v in enumerate(x):
        p = bisect.bisect_left(tops, v)
        before[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p], piles[p] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matching (place in a, place in b), increasing in both. Words that occur once in a and once in b anchor the
    alignment where they keep their order; the gaps between anchors are aligned in the same way, after their common
    ends are matched."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a: dict = {}
        for k in range(a0, a1):
            in_a[a[k]] = -1 if a[k] in in_a else k
        in_b: dict = {}
        for k in range(b0, b1):
            if in_a.get(b[k], -1) >= 0:
                in_b[b[k]] = -1 if b[k] in in_b else k
        both = sorted((in_a[w], k) for w, k in in_b.items() if k >= 0)
        if not both:
            continue
        chain = [both[k] for k in longest_increasing([j for _, j in both])]
        out += chain
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def template_words(templates: dict[str, str]) -> dict[str, np.ndarray]:
    return {name: h for name, text in templates.items() for _, _, h, _ in word_blocks(pa.array([text]))}


def least_cover(words: int) -> int:
    """Words of a template that must be matched."""
    return math.ceil((COVER_SHORT if words < SHORT else COVER_LONG) * words)


def in_text(words: np.ndarray, starts: np.ndarray, template: list) -> list[tuple[int, int, int]]:
    """(matched, start, end) of the template's places in a text. ``starts`` are the words from which on enough of the
    template's words follow. Of the alignments that begin within a template's length of the first that covers
    enough, the one that covers most is kept, the first of equals; the search goes on behind it."""
    m, found, k = len(template), [], 0
    reach, least = int(STRETCH * m), least_cover(len(template))
    while k < len(starts):
        best, limit, j = None, None, k
        while j < len(starts) and (limit is None or starts[j] < limit):
            p = int(starts[j])
            pairs = align(template, words[p : p + reach].tolist())
            if len(pairs) >= least:
                limit = limit or p + m
                if best is None or len(pairs) > best[0]:
                    best = (len(pairs), p + pairs[0][1], p + pairs[-1][1] + 1)
            j += 1
        if best is None:
            break
        found.append(best)
        k = int(np.searchsorted(starts, best[2]))
    return found


_FOUND = "doc_id long, license string, start int, end int, matched int, coverage double"


def license_texts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, matched, coverage): places of license texts, in words, end exclusive, with the
    words of the template that the patience alignment matches there and their share.

    A place counts from 75 % of a template's words on, 90 % for templates of under 20 words, within 1.5 times its
    length. Only where that many words of the template occur is an alignment tried: elsewhere none could cover enough.
    Of places that overlap, the one with more matched words stays, then the larger share, then the first name.

    Null doc_id or text and texts without such a place give no row; repeated rows give theirs each; texts are searched
    whole, extra columns are never read, an empty table gives an empty result."""
    known = template_words(templates)
    vocabulary = np.unique(np.concatenate(list(known.values())))
    member = {name: np.append(np.isin(vocabulary, h), False) for name, h in known.items()}
    lists = {name: h.tolist() for name, h in known.items()}

    def search(batches):
        for b in batches:
            for lo, _, h, off in word_blocks(b.column(1)):
                if not len(h):
                    continue
                at = np.searchsorted(vocabulary, h)
                at[at == len(vocabulary)] = 0
                at[vocabulary[at] != h] = len(vocabulary)
                ends = np.repeat(off[1:], np.diff(off))
                seen: dict[int, list] = {}
                for name, template in lists.items():
                    hit = member[name][at]
                    total = np.concatenate([[0], np.cumsum(hit)])
                    place = np.flatnonzero(hit)
                    reach = np.minimum(place + int(STRETCH * len(template)), ends[place])
                    place = place[total[reach] - total[place] >= least_cover(len(template))]
                    row = np.searchsorted(off, place, side="right") - 1
                    for r in np.unique(row):
                        for n, s, e in in_text(h[off[r] : off[r + 1]], place[row == r] - off[r], template):
                            seen.setdefault(int(r), []).append((-n, -n / len(template), name, s, e))
                out = []
                for r in sorted(seen):
                    taken: list[tuple[int, int]] = []
                    for n, share, name, s, e in sorted(seen[r]):
                        if all(e <= x or s >= y for x, y in taken):
                            taken.append((s, e))
                            out.append((lo + r, name, s, e, -n, -share))
                cols = list(zip(*out, strict=True)) or [[]] * 6
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)],
                    names=[x.split()[0] for x in _FOUND.split(", ")],
                )

    return ids_and_text(docs).mapInArrow(search, _FOUND)
