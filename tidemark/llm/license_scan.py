"""License scans: fingerprints pick candidates, alignment measures them.

Templates are cut into grams of ``K`` words, and winnowing keeps the least hash of
each ``PICK`` neighbours for an inverted index. Where a template is so short that the
share ``1 - coverage`` of changed, missing or inserted words could break every kept gram,
all its grams are kept, or shorter ones, so that a text with no more edits always has a
hit. A document's grams look them up; hits that lie on nearby diagonals are one candidate, and a banded local alignment of the
template's words with the document's (match 2, mismatch and gap -1) gives the matched
words and their span. Matches of at least ``coverage`` of the template's words are
reported; of overlapping ones the one with more matched words (then the greater
share) stays.

The templates are a bounded list that goes to the tasks; documents aren't shuffled.
Defined results: null and empty texts have no matches; repeated rows repeat their
matches; a template of fewer than K words is refused. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import small, split_words, table, tidy, utf8

K, PICK, BAND = 3, 2, 16
COVERAGE = 0.8
MAX_TEMPLATE_BYTES = 10_000_000

# Public license texts and notices, without the lines that name a holder.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-1-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "HPND": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def winnowed(keys: np.ndarray, pick: int = PICK) -> np.ndarray:
    """Places whose hash is the least (rightmost of equals) of some ``pick`` neighbours."""
    h = mixed(keys)
    if len(h) <= pick:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, pick)[:, ::-1]
    return np.unique(np.arange(len(w)) + pick - 1 - w.argmin(axis=1))


def cut(m: int, coverage: float) -> tuple[int, int]:
    """(words of a gram, neighbours of which one is kept) for a template of m words: edits of ``1 - coverage`` of them leave a run of as many words."""
    edits = int(m * (1 - coverage) + 1e-9)
    run = -(-(m - edits) // (edits + 1))
    k = max(1, min(K, run))
    return k, max(1, min(PICK, run - k + 1))


class Index:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        if sum(map(len, templates.values())) > MAX_TEMPLATE_BYTES:
            raise ValueError("the templates are more than a task should hold")
        self.names = sorted(templates)
        split = [split_words(templates[n].encode()) for n in self.names]
        if any(len(w) < K for w in split):
            raise ValueError(f"a template has fewer than {K} words")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.words = [np.array([self.vocabulary[w] for w in ws]) for ws in split]
        #: By the words of a gram: places of each kept one.
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.words):
            k, pick = cut(len(ids), coverage)
            keys, at = gram_keys(ids, k), self.at.setdefault(k, {})
            for p in winnowed(keys, pick).tolist():
                at.setdefault(int(keys[p]), []).append((t, p))
        self.keys = {k: np.array(sorted(at), np.int64) for k, at in self.at.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def gram_keys(ids: np.ndarray, n: int = K) -> np.ndarray:
    """A number for each n words, -1 if one is in no template; 3 words of a million make 60 bits."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    key, ok = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        key, ok = (key << 20) | np.maximum(part, 0), ok & (part >= 0)
    return np.where(ok, key, -1)


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int] | None:
    """Best local alignment within ``band`` of a diagonal (document place minus template place): (matched words, first, last + 1 in the document)."""
    m, width = len(template), 2 * band + 1
    d = np.arange(width)
    score = np.zeros((m + 1, width + 1), np.int32)  # the last column is never reached and stays 0
    steps = np.zeros((m, width), np.int8)
    for i in range(m):
        j = i + diagonal - band + d
        inside = (j >= 0) & (j < len(words))
        same = inside & (words[np.clip(j, 0, len(words) - 1)] == template[i])
        straight = score[i, :width] + np.where(same, 2, -1)
        down = score[i, 1 : width + 1] - 1
        best = np.maximum(np.maximum(straight, down), 0)
        best = np.where(inside, best, 0)
        run = np.maximum.accumulate(best + d) - d
        row = np.where(inside, run, 0)
        steps[i] = np.where(row <= 0, 0, np.where(row == straight, 1, np.where(row == down, 2, 3)))
        score[i + 1, :width] = row
    i, k = np.unravel_index(int(np.argmax(score[1:, :width])), (m, width))
    matched, first, last = 0, -1, -1
    while i >= 0 and 0 <= k < width and steps[i, k]:
        step = steps[i, k]
        if step == 1:
            j = int(i + diagonal - band + k)
            if words[j] == template[i]:
                matched += 1
                first, last = j, (j if last < 0 else last)
            i -= 1
        elif step == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return (matched, first, last + 1) if matched else None


def matches(index: Index, ids: np.ndarray, hits: list[tuple[int, int, int]], coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end) from hits (template, place in it, place in the document)."""
    found = []
    by: dict[int, list[tuple[int, int]]] = {}
    for t, p, q in hits:
        by.setdefault(t, []).append((q, q - p))
    for t, own in by.items():
        own.sort()
        size, left, alive = len(index.words[t]), ids.copy(), [True] * len(own)
        for i, (q, diagonal) in enumerate(own):
            while alive[i]:
                near = []
                for j in range(i, len(own)):
                    if own[j][0] > q + size + BAND:
                        break
                    if alive[j] and abs(own[j][1] - diagonal) <= BAND:
                        near.append(j)
                a = align(index.words[t], left, sorted(own[j][1] for j in near)[len(near) // 2])
                done = near
                if a is not None and a[0] >= coverage * size:
                    found.append((t, *a))
                    left[a[1] : a[2]] = -2  # so that another copy close by is found next
                    done = [j for j in near if a[1] <= own[j][0] < a[2]] or near
                for j in done:
                    alive[j] = False
    found.sort(key=lambda f: (-f[1], -f[1] / len(index.words[f[0]]), f[2], f[0]))
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # spans that stay, in order
    for f in found:
        k = bisect_left(taken, (f[2], f[3]))
        if (k == 0 or taken[k - 1][1] <= f[2]) and (k == len(taken) or taken[k][0] >= f[3]):
            taken.insert(k, (f[2], f[3]))
            kept.append(f)
    return sorted(kept, key=lambda f: f[2])


def scan_texts(index: Index, texts: list[bytes], coverage: float) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(text, name, matched words, template's words, first code point, end)."""
    words = [split_words(t) for t in texts]
    gap = np.full(K, -1)
    flat = np.concatenate([x for w in words for x in (index.ids(w), gap)]) if words else gap
    base = np.cumsum([0, *(len(w) + K for w in words)])
    some, where = [], []
    for k, at in index.at.items():
        keys = gram_keys(flat, k)
        place = np.flatnonzero(keys >= 0)
        place = place[np.isin(keys[place], index.keys[k])]
        some += [at[key] for key in keys[place].tolist()]
        where.append(place)
    place = np.concatenate(where)
    order = np.argsort(place, kind="stable")
    place, some = place[order], [some[o] for o in order.tolist()]
    doc = np.searchsorted(base, place, "right") - 1
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        ids = flat[base[d] : base[d] + len(words[d])]
        hits = [(t, p, q - int(base[d])) for q, found in zip(place[a:b].tolist(), some[a:b]) for t, p in found]
        got = matches(index, ids, hits, coverage)
        if got:
            at = [m.span() for m in WORD.finditer(texts[d])]
            for t, n, a, b in got:
                start = len(texts[d][: at[a][0]].decode("utf-8", "replace"))
                yield d, index.names[t], n, len(index.words[t]), start, start + len(texts[d][at[a][0] : at[b - 1][1]].decode("utf-8", "replace"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row per match: doc_id, license, coverage, matched_words, start, end (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in small(batches, 1):
            rows = list(scan_texts(index, utf8(b.column(1)), coverage))
            d, name, n, size, start, end = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d, pa.int64())), pa.array(name, pa.string()), pa.array([x / y for x, y in zip(n, size)], pa.float64()), *(pa.array(c, pa.int64()) for c in (n, start, end))],
                ["doc_id", "license", "coverage", "matched_words", "start", "end"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
