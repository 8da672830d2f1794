"""License scan by conditional compression.

Texts with license words are found natively, so most texts never leave the JVM. A notice may be wrapped over lines and
stand among other text: for each template, windows of the text's words that are little longer than the template and hold
enough of its words (as a confirmed block must) are candidate blocks. Each is compressed plainly and with the template as Zstandard raw-content dictionary,
and only where that saves at least `least_saving` of the template's own bytes it is compared by words. It is
confirmed by exact wording differences: words of the template that the block lacks, and their share, by a word-level
longest common subsequence. The block runs from its first to its last word in common with the template, and must itself save `least_saving` of its bytes.

Templates are the usual notices, and the licenses of up to some two hundred words in full; longer licenses are known by their notices.

Every confirmed license is a finding, at the line of its first word. Of findings that share more than half of their
words in the text only the best is kept: that whose dictionary saves most bytes, then with the least share of missing words, then by
name. Defined results: null and empty texts have no findings. Equal notices in a text are findings of their own, with
their lines' numbers (from 0). Rows are treated alone, so repeated rows repeat their findings. Extra columns are dropped unless in `keep`. An empty
table gives no findings.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: License notices by identifier; each may have several wordings. Fixed values.
_WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "{name} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format(name="This program", kind="Affero General Public License", version="3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD} {_WARRANTY_BSD}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", f"{_BSD} {_BSD3} {_WARRANTY_BSD}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format(name="This program", kind="General Public License", version="3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format(name="This program", kind="General Public License", version="2").replace("software:", "software;").replace("Foundation,", "Foundation;")],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format(name="This library", kind="Lesser General Public License", version="2.1").replace("software:", "software;").replace("Foundation,", "Foundation;")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format(name="This library", kind="Lesser General Public License", version="3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Proprietary": ["All rights reserved."],
}
#: Texts that can hold a notice; its words may be parted by line ends and comment signs.
HINT = r"(?i)licen[sc]|copyright|all[^a-z0-9]+rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|permission[^a-z0-9]+is[^a-z0-9]+hereby|redistribution[^a-z0-9]+and[^a-z0-9]+use|free[^a-z0-9]+software|free[^a-z0-9]+and[^a-z0-9]+unencumbered|permission[^a-z0-9]+(?:to[^a-z0-9]+use|is[^a-z0-9]+granted)|provided[^a-z0-9]+as[^a-z0-9]+is|creative[^a-z0-9]+commons|\bCC0\b"
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def aligned(template: np.ndarray, block: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in the block of a longest common subsequence with the template, and the template's other places. Words are numbers; in each
    step the earliest place in the block is taken that still allows the longest."""
    n, m = len(template), len(block)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        found = np.maximum(best[i + 1, :-1], np.where(block == template[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(found[::-1])[::-1]
    places, gone, i, j = [], [], 0, 0
    while i < n:
        if j < m and template[i] == block[j]:
            places.append(j)
            i, j = i + 1, j + 1
        elif j < m and best[i, j + 1] >= best[i + 1, j]:
            j += 1
        else:
            gone.append(i)
            i += 1
    return places, gone


class Matcher:
    def __init__(self, templates: dict[str, list[str]], level: int = 3, least_saving: float = 0.2, most_missing: float = 0.25):
        self.least_saving, self.most_missing = least_saving, most_missing
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates = []
        numbers: dict[str, int] = {}
        for name, texts in sorted(templates.items()):
            for t in texts:
                own = words(t)
                flat = " ".join(own)
                raw = zstandard.ZstdCompressionDict((flat + " ").encode() * (1 + 8 // max(1, len(flat))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                code = np.array([numbers.setdefault(w, len(numbers)) for w in own])
                self.templates.append((name, own, code, zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False)))
        self.numbers = numbers
        self.own = [len(self.plain.compress(" ".join(t).encode())) for _, t, _, _ in self.templates]
        self.known: dict[tuple, tuple | None] = {}

    def _saved(self, k: int, raw: bytes) -> tuple[int, int]:
        """Bytes of the plain frame, and by how many the frame with the template as dictionary is smaller."""
        whole = len(self.plain.compress(raw))
        return whole, whole - len(self.templates[k][3].compress(raw))

    def _confirm(self, k: int, block: tuple[str, ...], code: np.ndarray) -> tuple[list[int], int, float, list[str]] | None:
        """Places of the template's words in the block, bytes saved, their share, missing words."""
        if (k, block) in self.known:
            return self.known[k, block]
        _, template, numbers, _ = self.templates[k]
        out = None
        # the block may hold other words, so its saving is held against what the template's own words take
        if self._saved(k, " ".join(block).encode())[1] >= self.least_saving * self.own[k]:
            places, lost = aligned(numbers, code)
            gone = [template[i] for i in lost]
            # digits tell versions apart, so none may be missing
            if len(gone) <= self.most_missing * len(template) and not any(c.isdigit() for w in gone for c in w):
                whole, saved = self._saved(k, " ".join(block[places[0] : places[-1] + 1]).encode())
                if saved >= self.least_saving * max(whole, 1):
                    out = places, saved, saved / max(whole, 1), gone
        if len(self.known) < 20_000:
            self.known[k, block] = out
        return out

    def find(self, text: str) -> list[tuple[int, str, float, float, list[str], str]]:
        """line, license, share of bytes saved, share of the template's words that is there, missing words, block."""
        # every character stays one character, so that places hold in the text as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if len(text.lower()) != len(text) else text.lower()
        marks = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        own = [w for w, _, _ in marks]
        code = np.fromiter((self.numbers.get(w, -1) for w in own), np.int64, len(own))
        found = set()
        for k, (name, template, numbers, _) in enumerate(self.templates):
            n, m = len(template), len(own)
            fewest, width = n - int(self.most_missing * n), n + max(3, n // 4)
            inside = np.isin(code, numbers)
            total = np.concatenate([[0], np.cumsum(inside)])
            # a block begins with one of the first words, as only so many may be missing
            begins = np.flatnonzero(np.isin(code, numbers[: n - fewest + 1]))
            for s in begins[total[np.minimum(begins + width, m)] - total[begins] >= fewest].tolist():
                made = self._confirm(k, tuple(own[s : s + width]), code[s : s + width])
                if made:
                    places, saved, share, gone = made
                    found.add((-saved, len(gone) / n, name, tuple(s + p for p in places), share, tuple(gone)))
        used: set[int] = set()
        out = []
        for _, lost, name, places, share, gone in sorted(found):
            if 2 * len(used.intersection(places)) <= len(places):
                used.update(places)
                a, z = marks[places[0]][1], marks[places[-1]][2]
                out.append((text.count("\n", 0, a), name, share, 1 - lost, list(gone), text[a:z]))
        return sorted(out, key=lambda f: (f[0], f[1]))


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each finding: `keep`, line (from 0), license, saved, cover, missing, block."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.where(F.col(text).rlike(HINT)).select(*keep, F.col(text).alias("cw_text"))
    kinds = {"line": pa.int32(), "license": pa.string(), "saved": pa.float64(), "cover": pa.float64(), "missing": pa.list_(pa.string()), "block": pa.string()}

    def run(batches):
        tool = Matcher(templates or TEMPLATES)
        for batch in batches:
            found = [(k, f) for k, t in enumerate(batch.column("cw_text").to_pylist()) for f in tool.find(t)]
            took = batch.take(pa.array([k for k, _ in found], pa.int64()))
            cols = [pa.array([f[j] for _, f in found], t) for j, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([took.column(c) for c in keep] + cols, names=[*keep, *kinds])

    return rows.mapInArrow(run, f"{schema}, line int, license string, saved double, cover double, missing array<string>, block string")
