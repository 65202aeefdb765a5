"""License scans by patience alignment.

Text and template are compared as lower-cased words.  Words that occur once in both are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same way; a gap
without anchors is split at its longest common run.  Coverage is the share of template words that
are aligned.  A template is found where coverage reaches ``COVERAGE`` and at least ``DENSITY`` of the words between
the first and last aligned one are aligned.

Only the neighbourhoods of seed words are aligned.  A template's seeds are words that make up more than the share
it may lack, so any place with enough coverage holds a seed.  After a find, its words are set aside and
the rest is searched again, so repeated notices are all found; of overlapping finds the longest stays.

Edge cases: null texts count as empty; a text without a license has no spans and coverage 0; a very long text is read whole,
but only the neighbourhoods of seed words are aligned; repeated rows stay rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
DENSITY = 0.6
_WORD = re.compile(r"[^\W_]+")

# The wording of public licenses and of the usual notices that name them.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
TEMPLATES = {
    "Apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. " + _DISCLAIMER
    ),
    "CC-BY-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-name": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-name": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "MIT-name": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
#: Words too common in prose to be good seeds.
COMMON = frozenset("a above all an and any are as at be by for from in is it its may no not of on or other see shall that the this to under use with without you".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# -- alignment ------------------------------------------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_index: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_index.append(i)
        else:
            tops[pile], top_index[pile] = v, i
        before[i] = top_index[pile - 1] if pile else -1
    out, i = [], top_index[-1] if top_index else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def longest_run(a: list[str], b: list[str], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run, the earliest of equals."""
    places: dict[str, list[int]] = {}
    for j in range(blo, bhi):
        places.setdefault(b[j], []).append(j)
    best, lengths = (alo, blo, 0), {}
    for i in range(alo, ahi):
        now = {}
        for j in places.get(a[i], ()):
            n = now[j] = lengths.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        lengths = now
    return best


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {w: j for j, w in enumerate(b[blo:bhi], blo) if in_b[w] == 1 and in_a.get(w) == 1}
        unique = [(i, at[w]) for i, w in enumerate(a[alo:ahi], alo) if w in at]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        if not anchors:
            i, j, n = longest_run(a, b, alo, ahi, blo, bhi)
            if not n:
                continue
            out += [(i + k, j + k) for k in range(n)]
            todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            continue
        out += anchors
        bounds = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(bounds, bounds[1:], strict=False)]
    return sorted(out)


# -- search ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    seeds: frozenset[str]


def compile_templates(templates: dict[str, str], coverage: float = COVERAGE) -> list[Template]:
    """Seeds: the least common words, longest first, until what they make up cannot be lacking."""
    out = []
    for name, text in templates.items():
        words, seeds, held = words_of(text), set(), 0
        counts = Counter(words)
        for w in sorted(counts, key=lambda w: (w in COMMON, -len(w), w)):
            seeds.add(w)
            held += counts[w]
            if held > (1 - coverage) * len(words):
                break
        out.append(Template(name, tuple(words), frozenset(seeds)))
    return out


def find_licenses(text: str | None, templates: list[Template], coverage: float = COVERAGE, density: float = DENSITY) -> list[tuple[int, int, str, float]]:
    """(start, end, template, coverage) in code points by start, end exclusive; finds do not overlap."""
    low = (text or "").lower()
    if len(low) != len(text or ""):  # a few letters change length: keep positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    words = [w for w, _, _ in found]
    places: dict[str, list[int]] = {}
    seeds = frozenset().union(*(t.seeds for t in templates))
    for i, w in enumerate(words):
        if w in seeds:
            places.setdefault(w, []).append(i)
    hits = []
    for t in templates if places else ():
        n = len(t.words)
        reach = n + n // 2
        regions: list[list[int]] = []
        for i in sorted(i for s in t.seeds for i in places.get(s, ())):
            if regions and i - reach <= regions[-1][1]:
                regions[-1][1] = i + reach
            else:
                regions.append([max(0, i - reach), i + reach])
        todo = [(lo, min(hi, len(words))) for lo, hi in regions]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < coverage * n or t.seeds.isdisjoint(words[lo:hi]):
                continue
            if hi - lo > 4 * reach:  # a long region: overlapping parts, each long enough for a whole find
                todo += [(x, min(hi, x + 3 * reach)) for x in range(lo, hi - reach, 2 * reach)]
                continue
            pairs = densest(patience_align(words[lo:hi], list(t.words)), n)
            if len(pairs) < coverage * n or tightness(pairs) < n:
                # two edited notices may have drawn the alignment apart: look for one of them alone
                start, alone = best_window(words[lo:hi], t.words, coverage, density)
                if len(alone) >= coverage * n and (len(pairs) < coverage * n or tightness(alone) > tightness(pairs)):
                    pairs = [(start + i, j) for i, j in alone]
            if len(pairs) < coverage * n:
                continue
            first, last = lo + pairs[0][0], lo + pairs[-1][0] + 1
            if len(pairs) >= density * (last - first):
                hits.append((len(pairs), first, last, t.name, len(pairs) / n))
            todo += [(lo, first), (last, hi)]
    out: list[tuple[int, int, str, float]] = []
    taken: list[tuple[int, int]] = []
    for _, first, last, name, c in sorted(set(hits), key=lambda h: (-h[0], -h[4], h[1], h[3])):
        if all(last <= a or first >= b for a, b in taken):
            taken.append((first, last))
            out.append((found[first][1], found[last - 1][2], name, c))
    return sorted(out)


def tightness(pairs: list[tuple[int, int]]) -> int:
    """Aligned words less the others between the first and the last of them."""
    return 2 * len(pairs) - (pairs[-1][0] - pairs[0][0] + 1)


def best_window(words: list[str], template: tuple[str, ...], coverage: float, density: float) -> tuple[int, list[tuple[int, int]]]:
    """(start, pairs) of the tightest alignment of the template with a window of about its length.

    A find is at most len(template) / density words long.  Windows that share too few words with the template, in any
    order, hold none; of neighbouring windows the one that shares most is aligned.
    """
    n, best = len(template), (0, [])
    for width in sorted({max(1, int(n * x)) for x in (coverage, 0.9, 1, 1.125, 4 / 3, 1 / density)}):
        width = min(width, len(words))
        left, shared, counts = Counter(template), 0, []
        for i, w in enumerate(words):
            left[w] -= 1
            shared += left[w] >= 0
            if i >= width:
                gone = words[i - width]
                shared -= left[gone] >= 0
                left[gone] += 1
            if i >= width - 1:
                counts.append(shared)
        free = [True] * len(counts)
        for s in sorted(range(len(counts)), key=lambda s: -counts[s]):
            if counts[s] < coverage * n:
                break
            if free[s]:
                around = range(max(0, s - n // 8), min(len(free), s + n // 8 + 1))
                for k in around:
                    free[k] = False
                pairs = densest(patience_align(words[s : s + width], list(template)), n)
                if len(pairs) >= coverage * n and (not best[1] or tightness(pairs) > tightness(best[1])):
                    best = (s, pairs)
    return best


def densest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs without stray ones before or after a gap in the text longer than half the template."""
    best: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for p in pairs:
        if run and p[0] - run[-1][0] > max(8, n // 2):
            best, run = max(best, run, key=len), []
        run.append(p)
    return max(best, run, key=len)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id and found, an array of (start, end, license, coverage) by start."""
    compiled = compile_templates(templates, coverage)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                [{"start": s, "end": e, "license": name, "coverage": c} for s, e, name, c in find_licenses(t.as_py(), compiled, coverage)]
                for t in b.column("text")
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<start:long,end:long,license:string,coverage:double>>"
    return rows.mapInArrow(run, schema)
