"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches

# Names of licences and the wording of their notices, of the paragraphs of these, and of licence texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_HIT = "array<struct<license:string,dice:double,line_from:long,line_to:long,sentence:long>>"
_SENTENCE = re.compile(rb"[.!?][ \t]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and anything beyond ASCII; A-Z lower-cased."""
    return text.translate(_NORMAL).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    """Templates by their number of bigrams, so that bounds on the size pick the candidates.

    The Dice coefficient of sets of ``a`` and ``b`` bigrams is at most ``2 * min(a, b) / (a + b)``: only templates with
    ``t / (2 - t) * a <= b <= (2 - t) / t * a`` can reach ``t``.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        made = sorted((len(g), name, g) for name, text in templates if (g := bigrams(normal_words(text.encode()))))
        self.least, self.sizes, self.made = least, [n for n, *_ in made], made
        self.smallest = least / (2 - least) * min(self.sizes, default=math.inf)
        self.largest = (2 - least) / least * max(self.sizes, default=0)

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """The best template of at least ``least``, ties to the smaller name."""
        # Repeated bigrams only make the set smaller, so its size is looked at after that of the words.
        if len(words) - 1 < self.smallest:
            return None
        grams = bigrams(words)
        low, high = self.least / (2 - self.least) * len(grams), (2 - self.least) / self.least * len(grams)
        found = None
        for size, name, template in self.made[bisect.bisect_left(self.sizes, low - 1e-9) : bisect.bisect_right(self.sizes, high + 1e-9)]:
            dice = 2 * len(grams & template) / (size + len(grams))
            if dice >= self.least and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def scan(self, text: bytes | None) -> list[dict]:
        """Hits of the lines, of the sentences of lines with several, and of the paragraphs of several lines.

        Line numbers count from 0, both ends included; ``sentence`` numbers the sentences of a line, null for whole units.
        """
        raw = (text or b"").split(b"\n")
        lines = [normal_words(x) for x in raw]
        units, start = [], None
        for i, words in enumerate([*lines, []]):
            if words:
                units.append((i, i, None, words))
                if self._may_fit(len(words)):
                    pieces = [normal_words(x) for x in _SENTENCE.split(raw[i])]
                    if sum(map(bool, pieces)) > 1:
                        units += [(i, i, k, x) for k, x in enumerate(pieces)]
                start = i if start is None else start
            elif start is not None:
                if i - start > 1 and self._may_fit(sum(map(len, lines[start:i]))):
                    units.append((start, i - 1, None, [w for line in lines[start:i] for w in line]))
                start = None
        hits = ((a, b, k, self.best(words)) for a, b, k, words in units if self._may_fit(len(words)))
        return [{"license": h[1], "dice": h[0], "line_from": a, "line_to": b, "sentence": k} for a, b, k, h in hits if h]

    def _may_fit(self, words: int) -> bool:
        return words - 1 >= self.smallest


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8
) -> DataFrame:
    """Licence notices in the texts of ``docs(doc_id, text)``: ``(doc_id, license, dice, line_from,
    line_to, sentence)``.

    Every line, every sentence of a line with several, and every paragraph of several lines is compared with the
    templates whose size lets them reach ``least``; the best one of each is reported. Licences of several paragraphs have
    a template for each. Whole texts are scanned. Null and empty texts have none; repeated rows report each for itself;
    other columns do not come back; an empty table gives an empty result.
    """

    @F.pandas_udf(_HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(templates, least)
        for texts in batches:
            yield pd.Series([matcher.scan(x) for x in texts], dtype=object)

    def hits(text: Column) -> Column:
        return run(text.cast("binary"))

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.explode(hits(F.col("text"))).alias("hit")).select("doc_id", "hit.*")
