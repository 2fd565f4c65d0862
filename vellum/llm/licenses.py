"""License scans by patience alignment.

A template is aligned with the stretches of a text that could hold it, which are up to ``SPREAD`` fifths of its
length longer than it is: words that are unique in both are matched along their longest increasing subsequence, and the gaps between these anchors are aligned in the same way, down
to gaps without words unique to both. Coverage is the share of the template's words that are matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_slices

# Public license texts and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}
COVERAGE = 0.8
#: A stretch has as many words as the template and so many fifths of them more; what is spread wider isn't a finding.
SPREAD = 2
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

Words = Sequence[bytes]


def words(text: bytes) -> list[bytes]:
    """Words in lower case, cut at signs and white space."""
    return text.translate(_PLAIN).split()


def longest_rise(xs: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence, by piles of cards."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(xs)
    for i, x in enumerate(xs):
        pile = bisect_left(tops, x)
        back[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[pile], at[pile] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: Words, b: Words) -> list[tuple[int, int]]:
    """Places of matched words of ``a`` and ``b``, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, m, n = todo.pop()
        while i < j and m < n and a[i] == b[m]:
            out.append((i, m))
            i, m = i + 1, m + 1
        while i < j and m < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i == j or m == n:
            continue
        left, right = Counter(a[i:j]), Counter(b[m:n])
        where = {w: k for k, w in enumerate(b[m:n], m) if right[w] == 1}
        both = [(k, where[w]) for k, w in enumerate(a[i:j], i) if left[w] == 1 and w in where]
        anchors = [both[k] for k in longest_rise([y for _, y in both])]
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, m - 1), *anchors, (j, n)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.templates = {name: words(text.encode()) for name, text in templates.items()}
        self.coverage = coverage
        # A text that covers a template may lack so many of its words, and has one at least of any one more.
        self.hints: dict[bytes, list[str]] = {}
        for name, ws in self.templates.items():
            n, taken = Counter(ws), 0
            lacking = len(ws) - ceil(coverage * len(ws) - 1e-9)
            for w in sorted(n, key=lambda w: (n[w], -len(w), w)):
                if taken > lacking:
                    break
                taken += n[w]
                self.hints.setdefault(w, []).append(name)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, stop in code points), by start; for each license the best of findings that overlap."""
        raw = text.encode()
        plain = raw.translate(_PLAIN)
        if not self.hints.keys() & set(plain.split()):
            return []
        spans = [m.span() for m in _WORD.finditer(plain)]
        ws = [plain[a:b] for a, b in spans]
        places: dict[str, list[int]] = {}
        for k, w in enumerate(ws):
            for name in self.hints.get(w, ()):
                places.setdefault(name, []).append(k)
        out = []
        for name, hits in places.items():
            template = self.templates[name]
            size, slack, known = len(template), 1 + SPREAD * len(template) // 10, set(template)
            inside = list(accumulate((w in known for w in ws), initial=0))
            found, at = [], -size - slack
            for hit in hits:
                # Every place whose stretch holds the hint, with and without the words before, which may hold a word
                # of the template that isn't part of it. Nothing is better than the whole template.
                at = max(at, hit - size - slack + 1)
                while at <= hit + slack:
                    high = min(len(ws), max(0, at + size + slack))
                    lows = sorted({max(0, at - slack), min(high, max(0, at))})
                    at += 1
                    for low in lows:
                        if inside[high] - inside[low] < self.coverage * size:
                            break
                        pairs = align(template, ws[low:high])
                        if len(pairs) >= self.coverage * size:
                            found.append((-len(pairs), low + pairs[0][1], low + pairs[-1][1]))
                        if len(pairs) == size:
                            at = max(at, found[-1][1] + slack + 1)
                            break
            taken: list[tuple[int, int]] = []
            for n, a, b in sorted(set(found), key=lambda x: (x[0], x[2] - x[1], x)):
                if all(b < x or y < a for x, y in taken):
                    taken.append((a, b))
                    start = len(raw[: spans[a][0]].decode())
                    out.append((start, name, -n / len(template), start + len(raw[spans[a][0] : spans[b][1]].decode())))
        # A weaker finding inside a stronger one is the same words again.
        weaker = lambda x: any(y[2] > x[2] and y[0] <= x[0] and x[3] <= y[3] for y in out)
        return [(name, share, start, stop) for start, name, share, stop in sorted(out) if not weaker((start, name, share, stop))]


FOUND = "array<struct<license: string, coverage: double, start: int, stop: int>>"


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, licenses), templates of which a stretch of the text has ``coverage`` or more of the words.

    Words are compared in lower case and without signs. A stretch has two fifths more words than the template at most,
    so words may be put in between, but a template scattered over a text isn't a finding. A null or empty text has none;
    a very long one is searched whole. Findings of different licenses may overlap; of the same license the best is kept,
    then the shortest, then the first; a finding inside one of greater coverage is left out. Null and repeated ids keep
    their rows, an empty table gives none, other columns are not looked at.
    """
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
        for piece in text_slices(batches, "t"):
            rows = [[{"license": n, "coverage": c, "start": a, "stop": b} for n, c, a, b in scanner.scan(t or "")] for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, kind)], names=["id", "licenses"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id long, licenses {FOUND}")
