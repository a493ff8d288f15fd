"""License scans with a generalised suffix automaton of license tokens.

Templates are split into words (ASCII case doesn't count) and put into one suffix automaton. A document
is streamed through it: at each word the automaton gives the longest run of words, ending there, that
occurs in any template (matching statistics), and its suffix links the longest in each template. Runs
that can't be extended in their template and have at least ``min_match`` words are anchors: places of
that run in a document and in a template, whatever runs go on in others. Anchors of one
template that follow each other in both, with at most ``max_gap`` foreign words between, are chained
for the most covered words; a chain that covers at least ``min_cover`` of its template is a finding. Of
findings that overlap, the one that covers more words stays (ties: the earlier, then the shorter
template, then the name).

Words that no template has reset the automaton, so only runs of known words are walked; they are found
for a whole batch at once. Cost follows the text, memory the templates, whose size is fixed.

Defined cases: null and empty texts have no findings. Null or repeated doc_ids: every row is scanned by
itself and reports under its doc_id, so repeated rows repeat their findings. A template twice in a text
is found twice. Very long texts are scanned whole, one at a time. An empty table gives no rows. Other
columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _text
from .automaton import build
from .license_texts import TEXTS

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.7

TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 "
        '(the "License"); you may not use '
        "this file except in compliance with the License. You may "
        "obtain a copy of the License at "
        "http://www.apache.org/"
        "licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS '
        'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."
    ),
    "MIT/short": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD/short": (
        "Use of this source code is governed by a "
        "BSD-style license that can be found in the LICENSE "
        "file."
    ),
    "GPL-3.0/short": (
        "This work is licensed under the GNU General Public License, "
        "version 3."
    ),
    "GPL-2.0/short": (
        "This work is licensed under the GNU General Public License, "
        "version 2."
    ),
    "GPL/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL/notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser "
        "General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the "
        "Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this "
        "file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0/short": (
        "This work is licensed under a Creative Commons Attribution "
        "4.0 International License."
    ),
    "CC-BY-SA-4.0/short": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike "
        "4.0 International License."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public "
        "domain."
    ),
    # Without the disclaimers or what else follows; where all is there, the whole covers more.
    "MIT/permission": (
        "Permission is hereby granted, free of charge, to any "
        "person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT."
    ),
    "ISC/permission": (
        "Permission to use, copy, modify, and/or "
        "distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD-3-Clause/conditions": (
        "Redistribution and use in source and binary forms, with or "
        "without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither "
        "the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "GPL/notice/opening": (
        "This program is free software: you can redistribute it "
        "and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE."
    ),
    "LGPL/notice/opening": (
        "This library is free software; you can redistribute it "
        "and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software "
        "Foundation."
    ),
    "BSD-2-Clause/conditions": (
        "Redistribution and use in source and binary forms, with or "
        "without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    **TEXTS,
}


def split(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of one slab: start, end, row, hash."""
    data, offsets = _text.raw(texts)
    start, end, row = _text.words(data, offsets)
    return start, end, row, _text.hashes(data, start, end)


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.names, self.min_match, self.max_gap, self.min_cover = list(templates), min_match, max_gap, min_cover
        _, _, row, hashed = split(pa.array([templates[n] for n in self.names], pa.string()))
        self.vocabulary, tokens = np.unique(hashed, return_inverse=True)
        sequences = [tokens[row == k].tolist() for k in range(len(self.names))]
        self.sizes = [len(s) for s in sequences]
        self.move, self.link, self.size, _ = build(sequences)
        self.ends: list[set] = [set() for _ in self.move]  # of each state: the places (template, end) where its runs end
        for t, s in enumerate(sequences):
            state = 0
            for i, c in enumerate(s):
                state = self.move[state][c]
                self.ends[state].add((t, i + 1))
        for state in sorted(range(1, len(self.move)), key=lambda q: -self.size[q]):
            self.ends[self.link[state]] |= self.ends[state]
        #: Of each state: the templates of its runs; those that only shorter runs are in, by (state, words).
        self.whole: list[tuple] = [tuple({t for t, _ in e}) for e in self.ends]
        self.shorter: list[dict] = [{} for _ in self.move]
        for state in sorted(range(1, len(self.move)), key=lambda q: self.size[q]):
            q = self.link[state]
            if self.size[q] >= min_match:
                near = {t: (q, self.size[q]) for t in self.whole[q]} | self.shorter[q]
                self.shorter[state] = {t: x for t, x in near.items() if t not in self.whole[state]}

    def own_anchors(self, tokens) -> list[tuple[int, int, int, int]]:
        """(template, start in the text, start in the template, words) of the runs of ``tokens`` that
        can't be extended in their template; the tokens are all of the vocabulary."""
        out, state, n, before = [], 0, 0, {}
        for i, c in enumerate([*tokens, -1]):
            while state and c not in self.move[state]:
                state = self.link[state]
                n = self.size[state]
            state = self.move[state].get(c, 0)
            n = n + 1 if state else 0
            now = {t: (state, n) for t in self.whole[state]} | self.shorter[state] if n >= self.min_match else {}
            for t, (q, held) in before.items():
                if t not in now or now[t][1] <= held:  # its run before ends here
                    out += [(t, i - held, e - held, held) for k, e in self.ends[q] if k == t]
            before = now
        return out

    def anchors(self, tokens) -> list[tuple[int, int, int, int]]:
        """Those of :meth:`own_anchors` whose runs can't be extended in any template."""
        out, state, n = [], 0, 0
        for i, c in enumerate(tokens):
            before, held = state, n
            while state and c not in self.move[state]:
                state = self.link[state]
                n = self.size[state]
            state = self.move[state].get(c, 0)
            n = n + 1 if state else 0
            if held >= self.min_match and n <= held:  # the run before ends here
                out += [(t, i - held, e - held, held) for t, e in self.ends[before]]
        if n >= self.min_match:
            out += [(t, len(tokens) - n, e - n, n) for t, e in self.ends[state]]
        return out

    def chains(self, anchors) -> list[tuple[int, int, int, int]]:
        """(covered words, first word, end word, template) of the chains that cover enough."""
        out = []
        for t in sorted({a[0] for a in anchors}):
            own = sorted((s, u, n) for k, s, u, n in anchors if k == t)
            best, back = [n for _, _, n in own], [-1] * len(own)
            longest = max(best)
            for i, (s, u, n) in enumerate(own):
                j = i - 1
                while j >= 0 and s - own[j][0] <= self.max_gap + longest:
                    ps, pu, pn = own[j]
                    skip = max(0, ps + pn - s, pu + pn - u)  # words that both cover count once
                    if pu < u and ps < s and s - (ps + pn) <= self.max_gap and skip < n and best[j] + n - skip > best[i]:
                        best[i], back[i] = best[j] + n - skip, j
                    j -= 1
            for i in range(len(own)):
                if best[i] >= self.min_cover * self.sizes[t]:
                    first = i
                    while back[first] >= 0:
                        first = back[first]
                    out.append((best[i], own[first][0], own[i][0] + own[i][2], t))
        return out

    def choose(self, chains) -> list[tuple[int, int, int, int]]:
        """Those that stay where chains overlap, in order of place."""
        kept: list[tuple[int, int, int, int]] = []  # in order of place, apart from each other
        starts: list[int] = []
        for c in sorted(set(chains), key=lambda c: (-c[0], c[1], c[2], self.sizes[c[3]], self.names[c[3]])):
            at = bisect_left(starts, c[1])
            if (at == len(kept) or c[2] <= starts[at]) and (at == 0 or kept[at - 1][2] <= c[1]):
                starts.insert(at, c[1])
                kept.insert(at, c)
        return kept

    def scan(self, column: pa.Array):
        """(row, template, first byte, end byte, covered words) of every finding."""
        for first, stop, data, offsets in _text.slabs(column):
            start, end, row = _text.words(data, offsets)
            if not len(start):
                continue
            hashed = _text.hashes(data, start, end)
            at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashed
            edge = np.r_[True, known[1:] != known[:-1]] | np.r_[False, row[1:] != row[:-1]]
            heads = np.flatnonzero(edge)
            tails = np.r_[heads[1:], len(known)]
            runs = known[heads] & (tails - heads >= self.min_match)
            held: dict[int, list] = {}
            for a, b in zip(heads[runs].tolist(), tails[runs].tolist(), strict=True):
                found = self.own_anchors(at[a:b].tolist())
                if found:
                    held.setdefault(int(row[a]), []).extend((t, s + a, u, n) for t, s, u, n in found)
            for r, anchors in held.items():
                for covered, a, b, t in self.choose(self.chains(anchors)):
                    base = int(offsets[r])
                    yield first + r, t, int(start[a]) - base, int(end[b - 1]) - base, covered


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, license, start_byte, end_byte, covered, coverage): bytes of UTF-8 in the text, words
    of the template that are covered, and their part of it."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, min_match, max_gap, min_cover))

    def run(batches):
        s = shared.value
        for b in batches:
            found = list(s.scan(b.column(1)))
            rows, t, start, end, covered = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array([s.names[k] for k in t], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                 pa.array(covered, pa.int32()), pa.array([c / s.sizes[k] for k, c in zip(t, covered, strict=True)], pa.float64())],
                names=["doc_id", "license", "start_byte", "end_byte", "covered", "coverage"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(texts, run, "doc_id bigint, license string, start_byte int, end_byte int, covered int, coverage double")
