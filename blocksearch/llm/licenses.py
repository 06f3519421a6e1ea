"""License scan by conditional compression.

Units of a text (the sentences of its lines) with a license cue open a candidate
block; neighbours made almost wholly of template words join it, and so do short
ones, such as numbers, between those that do. A block is compressed alone and
with each template as zstandard raw dictionary; the templates are ranked by what
they save. All that save anything are confirmed by their exact wording: the words
of the template that the block lacks and those it has besides are counted and
returned, versions and names must be there as they are, and no word of the block
may be another license's name or clause. A title is confirmed only where it
stands alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure

# Wording of licenses and of the notices that point to them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the terms of the GNU General Public License v3.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
)
# The titles of licenses; found only where nothing else stands in the block.
TITLES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "License: MIT"), ("MIT", "MIT licensed"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "License: Apache-2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "License: GPL-3.0"), ("GPL-2.0", "License: GPL-2.0"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "License: BSD-3-Clause"), ("BSD-2-Clause", "License: BSD-2-Clause"),
)
CUES = ("licen", "copyright", "spdx", "permission is hereby", "permission to use", "redistribut", "public domain", "all copyright")

#: Names and clauses that make another license of a text whose template lacks them.
OTHERS = frozenset("lesser affero mozilla mpl apache bsd isc gnu gpl lgpl agpl cc0 by-sa by-nc by-nd sharealike noncommercial noderivatives noderivs endorse advertising evil".split())

#: Words that a license's name begins with; it ends at the next "license", if that
#: is one of the ``NAME`` words after; none of it may lack or be added to.
NAMED, NAME = frozenset("gnu mozilla eclipse boost creative".split()), 7

#: The share of a template's words that may be missing, and of added words to
#: template words.
MISSING, ADDED = 0.1, 0.35
#: The share of a unit's words that are template words, for it to join a block;
#: a unit of fewer words joins where those beside it do.
ALIKE, SHORT = 0.9, 3
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?](?![\s]|$)[^.!?]*)*[.!?]?\s*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _compiled():
    """Of each template and title: license, words, how often it has each, the
    words that must be there as they are (names and versions), a compressor with
    it as dictionary, whether it must stand alone, and the places in its words
    that are inside a license's name, which has to be there as it is."""
    out = []
    for name, text in TEMPLATES + TITLES:
        words = words_of(text)
        raw = " ".join(words).encode()
        exact = {w for w in words if any(c.isdigit() for c in w)} | {w for w in words_of(name.replace("-", " ")) if w in words} | (OTHERS & set(words))
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        inside = {i for a, w in enumerate(words) if w in NAMED and "license" in words[a : a + NAME] for i in range(a + 1, words.index("license", a) + 1)}
        out.append((name, words, Counter(words), exact, pack, (name, text) in TITLES, inside))
    return out, {w for _, words, *_ in out for w in words}, zstandard.ZstdCompressor(level=3, write_content_size=False)


def units(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the sentences of each line."""
    at = 0
    for line in text.split("\n"):
        for m in _SENTENCE.finditer(line):
            if m.group().strip():
                yield at + m.start(), at + m.start() + len(m.group().rstrip())
        at += len(line) + 1


def blocks(text: str) -> list[tuple[int, int]]:
    """The spans of candidate blocks."""
    low = text.lower()
    if len(low) != len(text) or not any(c in low for c in CUES):
        if len(low) == len(text):
            return []
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # keep places
    vocabulary = _compiled()[1]
    spans = list(units(text))
    kinds, short = [], []
    for a, b in spans:
        part = low[a:b]
        words = words_of(part)
        known = sum(w in vocabulary for w in words)
        kinds.append(2 if any(c in part for c in CUES) else int(len(words) >= SHORT and known >= ALIKE * len(words)))
        short.append((len(words) < SHORT, known == len(words) and any(c.isdigit() for c in part)))  # a version may end a block
    k = 0
    while k < len(spans):  # runs of short units between others
        end = k
        while end < len(spans) and not kinds[end] and short[end][0]:
            end += 1
        if end > k and k and kinds[k - 1] and (end < len(spans) and kinds[end] or all(s[1] for s in short[k:end])):
            kinds[k:end] = [1] * (end - k)
        k = max(end, k + 1)
    out, i = [], 0
    while i < len(spans):
        j = i
        while j < len(spans) and kinds[j]:
            j += 1
        if 2 in kinds[i:j]:
            out.append((spans[i][0], spans[j - 1][1]))
        i = max(j, i + 1)
    return out


def confirmed(words: list[str], template: tuple) -> tuple[list[str], list[str]] | None:
    """The template's words that ``words`` lack and those they have besides;
    None if that is too much, or another license."""
    _, wanted, often, exact, _, alone, inside = template
    seen = set(words)
    if not exact <= seen or (OTHERS - set(wanted)) & seen or alone and words != wanted:
        return None
    if sum((often - Counter(words)).values()) > MISSING * len(wanted):  # no alignment can lack less
        return None
    steps = SequenceMatcher(None, wanted, words, autojunk=False).get_opcodes()
    while steps and steps[0][0] == "insert":  # what stands before and after isn't a difference
        steps.pop(0)
    while steps and steps[-1][0] == "insert":
        steps.pop()
    if any(a in inside if tag == "insert" else tag != "equal" and inside & set(range(a, b)) for tag, a, b, *_ in steps):
        return None
    gone = [w for tag, a, b, _, _ in steps if tag in ("delete", "replace") for w in wanted[a:b]]
    more = [w for tag, _, _, a, b in steps if tag in ("insert", "replace") for w in words[a:b]]
    if len(gone) > MISSING * len(wanted) or len(more) > ADDED * len(wanted) or exact & set(gone) or any(c.isdigit() for w in more for c in w):
        return None
    return gone, more


def match(block: str) -> tuple[str, int, int, int, str] | None:
    """license, bytes saved, words missing, words added and the differences
    (``-word``, ``+word``) of the best confirmed template: the one with the most
    words in common less the differences, then the most bytes saved, then the
    first in the tables."""
    templates, _, plain = _compiled()
    words = words_of(block)
    raw = " ".join(words).encode()
    alone = len(plain.compress(raw))
    ranked = sorted(((alone - len(t[4].compress(raw)), -i) for i, t in enumerate(templates)), reverse=True)
    best = None
    for saved, i in ranked:
        if saved <= 0:
            break
        differences = confirmed(words, templates[-i])
        if differences:
            gone, more = differences
            key = (len(templates[-i][1]) - 2 * len(gone) - len(more), saved)
            if best is None or key > best[0]:
                best = key, (templates[-i][0], saved, len(gone), len(more), " ".join([f"-{w}" for w in gone] + [f"+{w}" for w in more]))
    return best and best[1]


def scan(text: str | None) -> list[tuple[str, int, int, int, int, int, str]]:
    """(license, start, stop, saved, missing, added, differences) of each block
    that is confirmed; places in code points. Null has none. A block that holds
    several notices is looked at unit by unit."""
    out = []
    for a, b in blocks(text) if text else []:
        parts = [(p, q) for p, q in units(text[a:b]) if any(c in text[a + p : a + q].lower() for c in CUES)]
        whole = match(text[a:b])
        each = [(p, q, match(text[a + p : a + q])) for p, q in parts] if len(parts) > 1 else []
        found = [(a + p, a + q, m) for p, q, m in each if m]
        alone = len(found) <= 1
        if found:  # what stands between notices may be a whole one
            edges = [a, *(x for p, q, _ in found for x in (p, q)), b]
            found += [(p, q, m) for p, q in zip(edges[::2], edges[1::2], strict=True) if p < q and (m := match(text[p:q]))]
            found.sort(key=lambda f: f[:2])
        if whole and alone and {m[0] for *_, m in found} <= {whole[0]}:
            found = [(a, b, whole)]
        out += [(m[0], p, q, *m[1:]) for p, q, m in found]
    return out


_OUT = "license string, start int, stop int, saved int, n_missing int, n_added int, differences string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed notice: ``doc_id, license, start, stop, saved,
    n_missing, n_added, differences``.

    Null and empty texts, and an empty table, give no rows; repeated rows give
    theirs each time; null identifiers stay null; other columns are not looked
    at. Every whole text is searched, however long. Of templates that tie the one
    with more bytes saved counts, then the first in the tables."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [pa.string(), *[pa.int32()] * 5, pa.string()]
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for found in scan(text):
                    at.append(i)
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")
