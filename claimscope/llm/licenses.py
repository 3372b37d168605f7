"""License scans by conditional compression.

Templates are one-line notices, file headers and whole license texts. Cues come from the templates: a stretch with at most m words missing
has one of any m + 1 different words, so m + 1 of each template's words, the longest, are looked for with an automaton. A candidate block is the words
within the template's reach of its cues, across line breaks, for notices are wrapped; blocks that have too few of the template's words for any
confirmation go. The rest is compressed alone and with the template as zstandard raw dictionary; the reduction is 1 - conditional / alone. Every template
with a positive reduction is confirmed by exact wording differences: it is aligned with the stretch of words that has fewest template words missing plus words
the template has not, and these must be at most ``MAX_DIFFERENCE`` of the template's. Words before and after the stretch do not count: a notice may stand in a longer line.

Of confirmed stretches that overlap the one with most words matched less differences stays (ties: reduction, place, name), so a notice is reported
once and each notice of a text has its row. Case, punctuation and comment marks do not count. Defined cases: null or empty text has
no blocks; repeated rows are scanned each; a line without line breaks is scanned however long; empty tables give no rows; null ids are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from claimscope.llm.hashing import few_rows

# Wordings of common license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal, public domain dedication.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License',
    "GPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means',
}
MAX_DIFFERENCE, LEVEL, BLOCK = 0.1, 3, 4_096
_WORDS = re.compile(r"\w+(?:[.-]\w+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


def places(template: list[str], block: list[str], most: int) -> list[tuple[int, int, list[str], list[str]]]:
    """(start, end, missing, extra) of stretches of ``block`` that differ from the template by at most ``most`` words.

    Missing are template words the stretch lacks, extra its words the template lacks; the best stretch from each start. The stretch may begin
    anywhere; a row of differences is the least of the row above, or the diagonal where words agree, and of steps along the row.
    """
    n, m = len(template), len(block)
    code: dict[str, int] = {}
    b = np.array([code.setdefault(w, len(code)) for w in block], dtype=np.int64)
    column = np.arange(m + 1)
    d = np.zeros((n + 1, m + 1), dtype=np.int32)
    for i, w in enumerate(template, 1):
        row = d[i - 1] + 1
        np.copyto(row[1:], d[i - 1, :-1], where=b == code.get(w, -1))
        d[i] = np.minimum.accumulate(row - column) + column
    best: dict[int, tuple] = {}
    have = set(template)
    for end in np.flatnonzero(d[n] <= most)[::-1].tolist():
        if not end or block[end - 1] not in have:
            continue
        i, j, missing, extra = n, end, [], []
        while i:
            if j and template[i - 1] == block[j - 1]:
                i, j = i - 1, j - 1
            elif j and d[i, j] == d[i, j - 1] + 1:
                j -= 1
                extra.append(block[j])
            else:
                i -= 1
                missing.append(template[i])
        found = (len(missing) + len(extra), -end)
        if j < end and (j not in best or found < best[j][0]):
            best[j] = (found, missing[::-1], extra[::-1])
    return [(j, -end, missing, extra) for j, ((_, end), missing, extra) in best.items()]


def most_differences(template: list[str]) -> int:
    return int(MAX_DIFFERENCE * len(template))


def cue_words(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """Templates by cue: the longest of each template's words, one more than may be missing; words that are cues already come first."""
    cues: dict[str, list[str]] = {}
    for name, ws in sorted(templates.items(), key=lambda t: (len(t[1]), t[0])):
        for w in sorted(set(ws), key=lambda w: (w not in cues, -len(w), w))[: most_differences(ws) + 1]:
            cues.setdefault(w, []).append(name)
    return cues


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.known = {}
        for name, text in templates.items():
            ws = words(text)
            raw = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.known[name] = (ws, Counter(ws), most_differences(ws), zstandard.ZstdCompressor(level=LEVEL, dict_data=raw))
        self.cues = cue_words({name: k[0] for name, k in self.known.items()})
        self.automaton = ahocorasick.Automaton()
        for w in self.cues:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def blocks(self, name: str, at: list[int], n: int) -> Iterator[tuple[int, int]]:
        """Ranges of words within the template's reach of its cues; long ones in parts that overlap by a whole stretch."""
        ws, _, most, _ = self.known[name]
        reach, lo, hi = len(ws) + most, None, 0
        for i in [*at, None]:
            if lo is not None and (i is None or i - reach > hi):
                for part in range(lo, max(hi - reach, lo + 1), BLOCK):
                    yield part, min(part + BLOCK + reach, hi)
                lo = None
            if i is not None:
                lo, hi = max(i - reach, 0) if lo is None else lo, min(i + reach + 1, n)

    def confirmed(self, name: str, block: list[str]) -> list[tuple]:
        """(start, end, reduction, missing, extra) of every stretch of the block that the template's wording confirms."""
        ws, count, most, compressor = self.known[name]
        have = Counter(block)
        if sum(min(n, have[w]) for w, n in count.items()) < len(ws) - most:
            return []
        data = " ".join(block).encode("utf-8", "surrogatepass")
        reduction = 1 - len(compressor.compress(data)) / len(self.plain.compress(data))
        return [(a, b, reduction, missing, extra) for a, b, missing, extra in places(ws, block, most)] if reduction > 0 else []

    def scan(self, text: str | None) -> list[tuple]:
        """(block_no, start, license, reduction, missing, extra) of each notice of the text, by place."""
        if not text or next(self.automaton.iter(text.lower()), None) is None:
            return []
        found = [(m.start(), m[0].lower()) for m in _WORDS.finditer(text)]
        have = [w for _, w in found]
        cued: dict[str, list[int]] = {}
        for i, w in enumerate(have):
            for name in self.cues.get(w, ()):
                cued.setdefault(name, []).append(i)
        hits: dict[tuple, tuple] = {}
        for name, at in cued.items():
            for lo, hi in self.blocks(name, at, len(have)):
                for a, b, reduction, missing, extra in self.confirmed(name, have[lo:hi]):
                    key, old = (lo + a, lo + b, name), hits.get((lo + a, lo + b, name))
                    if old is None or reduction > old[0]:
                        hits[key] = (reduction, missing, extra)
        taken, out = set(), []
        worth = lambda x: (2 * len(x[1][2]) + len(x[1][1]) - (x[0][1] - x[0][0]), -x[1][0], x[0])
        for (a, b, name), (reduction, missing, extra) in sorted(hits.items(), key=worth):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((found[a][0], name, reduction, missing, extra))
        breaks = [m.start() for m in re.finditer("\n", text)] if out else []
        return [(bisect_right(breaks, x[0]), *x) for x in sorted(out, key=lambda x: x[0])]


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.string())
        for batch in few_rows(batches):
            found = [(i, *hit) for i, text in enumerate(batch.column("text").to_pylist()) for hit in scanner.scan(text)]
            at, no, start, name, reduction, missing, extra = zip(*found, strict=True) if found else ((),) * 7
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(name, pa.string()), pa.array(reduction, pa.float64()), pa.array(missing, kind), pa.array(extra, kind)], ["doc_id", "block_no", "start", "license", "reduction", "missing", "extra"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per notice: doc_id, block_no (its first line, from 0), start (its first word, code points), license, reduction, missing, extra."""
    return docs.select("doc_id", "text").mapInArrow(_scan(templates or TEMPLATES), "doc_id long, block_no int, start int, license string, reduction double, missing array<string>, extra array<string>")
