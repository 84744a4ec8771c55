"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case (bytes above 127 count as letters). A template of n shingles of SHINGLE
words (of all its words where it has fewer, but three at least) belongs to the class of the least power of two, h, that is n or more. Windows of 2h shingles begin every h, so one of
them holds any occurrence whole; at containment 0.8 its Jaccard similarity to the template exceeds 0.4h / 2.1h = 0.19, and
BANDS bands of one row each then collide with a probability above 1 - 0.81 ** 64 = 0.999998. Windows that collide in a band
are joined where they overlap or touch, and compared with the class's templates word by word: a template matches where at
least CONTAINMENT of its different shingles are in 2h in a row, and each of several copies has a row. Windows run on from one text to the next, but matches are looked for inside a text.

Templates are passages of licenses, whole licenses (TEMPLATES and the folder license_texts) and notices: each way to grant
(GRANTS) with each way to call a license (CALLED), and its SPDX line. A notice's own words, as its version, must all be in the
occurrence, so a version 2 is no 0.8 of a version 3. Of occurrences of one license name's wordings that lie within another of
that name, the outer one is the match.

The templates of one pass travel with the tasks, at most PASS_BYTES of them; more are scanned in further passes.

Defined cases. Null and empty texts match nothing. Texts of fewer words than a template's shingle do not match it; a template of fewer
than three words is an error. Repeated rows are scanned one by one; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, of, text_slices, texts

SHINGLE = 5
SHORTEST = 3
BANDS = 64
CONTAINMENT = 0.8
PASS_BYTES = 16 << 20
SEED = 42
SLICE = 2 << 20
FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
FOUND_DDL = "doc_id long, license string, start long, end long, containment double"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR '
    "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Licenses and notices as they are worded. A name may have several: "-text" is a whole license, "-notice" a line that names one.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed "
        "without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, '
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:"
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."
    ),
}
TEMPLATES |= {
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
        "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _AS_IS.replace(" OR COPYRIGHT HOLDERS", "")
    ),
    "MIT-text": f"{TEMPLATES['MIT']} {_AS_IS}",
    "ISC-text": (
        f"{TEMPLATES['ISC']} "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-2-Clause']} {_BSD_AS_IS}",
    "BSD-3-Clause-text": (
        f"{TEMPLATES['BSD-2-Clause']} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        f"written permission. {_BSD_AS_IS}"
    ),
}

# How licenses are granted and what they are called.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "provided under", "published under", "covered by", "subject to", "governed by")
CALLED = {
    "MIT": ("the MIT license", "the terms of the MIT license", "an MIT license", "a MIT license", "the MIT licence"),
    "ISC": ("the ISC license", "the terms of the ISC license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "the terms of the Apache License, Version 2.0", "the terms of the Apache License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "a BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "a BSD 3-Clause License", "the New BSD License", "the Modified BSD License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the terms of the GNU General Public License, version 2", "the GNU GPL v2", "the GPL version 2", "the GPL v2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the terms of the GNU General Public License, version 3", "the GNU GPL v3", "the GPL version 3", "the GPL v3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1", "the LGPL version 2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3", "the LGPL version 3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3", "the AGPL version 3"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the terms of the Mozilla Public License, v. 2.0", "the MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "the Eclipse Public License v2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "Unlicense": ("the Unlicense license", "the terms of the Unlicense"),
    "CC0-1.0": ("CC0 1.0 Universal", "a Creative Commons Zero v1.0 Universal license", "the Creative Commons CC0 1.0 Universal license"),
    **{
        f"CC-{code}-{version}": (f"CC {code} {version}", f"a Creative Commons {long} {version} International License", f"the Creative Commons {long} {version} International License", f"Creative Commons {long} {version}")
        for code, long in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for version in ("4.0",)
    },
}
COMMON = frozenset(b"the a an of terms license licence version v".split())

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


@cache
def known() -> dict[str, str | tuple[str, ...]]:
    """All templates by name; a name's several texts are wordings."""
    out: dict[str, str | tuple[str, ...]] = dict(TEMPLATES)
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        out[f"{file.name.removesuffix('.txt')}-text"] = file.read_text(encoding="utf-8")
    for name, ways in CALLED.items():
        own = tuple(f"{grant} {way}" for grant in GRANTS for way in ways) + (f"SPDX-License-Identifier: {name}",)
        out[f"{name}-notice"] = ((out[f"{name}-notice"],) if f"{name}-notice" in out else ()) + own
    return out


def needed(name: str, words: Sequence[bytes]) -> frozenset[bytes]:
    """The words of a template that an occurrence must have: a notice's, but for those that say how it is granted."""
    return frozenset(words).difference(COMMON, *(g.encode().split() for g in GRANTS), b"this work is".split()) if name.endswith("-notice") else frozenset()


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Templates:
    """Templates of one shingle length by class, with their band keys."""

    def __init__(self, named: dict[str, str | tuple[str, ...]], size: int = SHINGLE):
        self.size = size
        self.multipliers = (np.random.default_rng(SEED).integers(1, 1 << 63, BANDS, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.classes: dict[int, list[tuple[str, dict, int, frozenset]]] = {}
        keys: dict[int, list[np.ndarray]] = {}
        for name, text in named.items():
            for own in {tuple(words_of(t)): None for t in ((text,) if isinstance(text, str) else text)}:
                if len(own) < SHORTEST:
                    raise ValueError(f"template {name} has fewer than {SHORTEST} words")
                if min(len(own), SHINGLE) != size:
                    continue
                shingles = shingle_hashes(word_hashes(b" ".join(own))[0], size)
                h = 1 << max(0, (len(shingles) - 1).bit_length())
                places: dict[tuple, list[int]] = {}
                for i, s in enumerate(_grams(own, size)):
                    places.setdefault(s, []).append(i)
                self.classes.setdefault(h, []).append((name, places, len(own), needed(name, own)))
                keys.setdefault(h, []).append(np.array([((shingles * m) >> np.uint64(32)).astype(np.uint32).min() for m in self.multipliers]))
        self.keys = {h: np.stack(k, 1) for h, k in keys.items()}
        self.marked = {h: np.zeros((BANDS, 1 << 16), bool) for h in keys}
        for h, k in self.keys.items():
            for band in range(BANDS):
                self.marked[h][band][k[band].astype(np.uint16)] = True

    def of_class(self, h: int, words: list[bytes]) -> list[tuple[str, dict, int, frozenset]]:
        """The templates of a class whose needed words are all there."""
        have = set(words)
        return [t for t in self.classes[h] if t[3] <= have]


def _grams(words: Sequence[bytes], size: int) -> list[tuple]:
    return list(zip(*(words[i:] for i in range(size)), strict=False))


def by_size(named: dict[str, str | tuple[str, ...]]) -> list[Templates]:
    """Those of SHINGLE words and more, and the shorter ones by their number of words."""
    return [t for t in (Templates(named, size) for size in range(SHINGLE, SHORTEST - 1, -1)) if t.classes]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of plain bytes: sums of bytes times powers, moved to the word's start."""
    x = np.frombuffer(data, np.uint8)
    inside = np.r_[False, x != 32, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    power = _powers(len(x))
    sums = np.r_[np.uint64(0), np.cumsum(x.astype(np.uint64) * power, dtype=np.uint64)]
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.full(len(x) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    value = (sums[ends] - sums[starts]) * back[starts]
    value ^= value >> np.uint64(29)
    return value * np.uint64(0xBF58476D1CE4E5B9), starts, ends


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x94D049BB133111EB) + words[i : i + n]
    return out ^ (out >> np.uint64(31))


def candidate_windows(shingles: np.ndarray, templates: Templates) -> dict[int, np.ndarray]:
    """By class h, the windows j (shingles j * h to j * h + 2h) that collide with a template of the class in some band.

    A template of class 1 is one shingle, so each band says the same of it and one is asked. Of the others' windows those go to
    the exact look-up whose last bits some key of the band has.
    """
    hits: dict[int, list[np.ndarray]] = {h: [] for h in templates.keys}
    top = max(templates.keys, default=0)
    padded = -(-len(shingles) // (2 * top)) * 2 * top if top else 0
    for band, m in enumerate(templates.multipliers[: 1 if top == 1 else BANDS]):
        least = np.full(padded, 0xFFFFFFFF, np.uint32)
        least[: len(shingles)] = (shingles * m) >> np.uint64(32)
        h = 1
        while h <= top:
            if h in hits and (h > 1 or band == 0):
                some = np.flatnonzero(templates.marked[h][band][least.astype(np.uint16)])  # a window's least is that of one of its halves
                hits[h].append(some[np.isin(least[some], templates.keys[h][band])])
            least, h = np.minimum(least[::2], least[1::2]), h * 2
    return {h: _either(np.unique(np.concatenate(own)), -(-len(shingles) // h)) for h, own in hits.items() if own}


def _either(halves: np.ndarray, n: int) -> np.ndarray:
    """The windows that hold one of those halves."""
    out = np.unique(np.concatenate([halves - 1, halves]))
    return out[(out >= 0) & (out < n)]


def _pieces(grams: list[tuple], places: dict[tuple, list[int]]) -> list[tuple[int, int]]:
    """Stretches of shingles (first, last) that follow each other in the template as they do in words."""
    out: list[tuple[int, int]] = []
    open_: list[int] = []
    for i, s in enumerate(grams):
        own = places.get(s)
        if own is None:
            open_ = []
            continue
        after = [p for p in own if p - 1 in open_]
        if after:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
        open_ = after or own
    return out


def _before(pieces: list[tuple[int, int]], i: int, size: int) -> int:
    """How many of the stretches share no word with stretch i and come before it."""
    j = i
    while j and pieces[j - 1][1] + size > pieces[i][0]:
        j -= 1
    return j


def _occurrences(words: list[bytes], first: int, template: tuple[str, dict, int, frozenset], containment: float, most: int, size: int) -> list[tuple[float, int, int, str]]:
    """(containment, first word, end word, name) of each occurrence of a template in words that begin at word `first` of their text.

    An occurrence is one or more stretches in at most `most` shingles. Chosen are those apart from each other with the
    greatest sum of 2 * containment - 1: so two copies count as two, and no tail of one with the head of the next takes their place.
    """
    name, places, _, own = template
    need = containment * len(places)
    grams = _grams(words, size)
    pieces = _pieces(grams, places)
    best: list[tuple[float, int, int, float]] = [(0.0, 0, -1, 0.0)]  # up to each stretch: sum, minus words, first stretch of the last occurrence (-1: none), its share
    for r, (_, last) in enumerate(pieces):
        now = (*best[-1][:2], -1, 0.0)
        seen: set = set()
        for i in range(r, -1, -1):
            begin, end = pieces[i]
            if last - begin >= most:
                break
            seen.update(grams[begin : end + 1])
            if len(seen) < need or not own <= set(words[begin : last + size]):
                continue
            j = _before(pieces, i, size)
            share = len(seen) / len(places)
            new = (best[j][0] + 2 * share - 1, best[j][1] - (last - begin), i, share)
            if new[:2] > now[:2]:
                now = new
        best.append(now)
    out, r = [], len(pieces)
    while r:
        _, _, i, share = best[r]
        if i < 0:
            r -= 1
            continue
        out.append((share, first + pieces[i][0], first + pieces[r - 1][1] + size, name))
        r = _before(pieces, i, size)
    return out[::-1]


def _outer(found: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """Without those that lie within another of the same name; of equal stretches the greatest share stays. In order of their places."""
    out, ends = [], {}
    for one in sorted(found, key=lambda t: (t[1], -t[2], t[3], -t[0])):
        if one[2] > ends.get(one[3], -1):
            ends[one[3]] = one[2]
            out.append(one)
    return sorted(out, key=lambda t: (t[1], t[2], t[3]))


def matches(rows: list[str], templates: Templates | list[Templates], containment: float = CONTAINMENT) -> list[list[tuple[int, int, str, float]]]:
    """Per text (start, end, name, containment), code points; occurrences of one template don't overlap."""
    plain = [t.encode("utf-8", "surrogatepass").translate(_PLAIN) for t in rows]
    offsets = np.r_[0, np.cumsum(np.fromiter((len(p) + 1 for p in plain), np.int64, len(plain)))]
    data = b" ".join([*plain, b""])
    hashes, starts, ends = word_hashes(data)
    out: list[list] = [[] for _ in rows]
    first_word = np.searchsorted(starts, offsets)
    found: dict[int, list] = {}
    for some in [templates] if isinstance(templates, Templates) else templates:
        shingles = shingle_hashes(hashes, some.size)
        for h, windows in candidate_windows(shingles, some).items() if len(shingles) else ():
            for group in np.split(windows, np.flatnonzero(np.diff(windows) > 2) + 1) if len(windows) else []:  # windows that overlap or touch
                a, b = int(group[0]) * h, min((int(group[-1]) + 2) * h + some.size - 1, len(starts))
                doc = int(np.searchsorted(first_word, a, side="right")) - 1
                while doc < len(rows) and first_word[doc] < b:
                    x, y = max(a, int(first_word[doc])), min(b, int(first_word[doc + 1]))
                    words = [data[starts[i] : ends[i]] for i in range(x, y)]
                    for template in some.of_class(h, words):
                        found.setdefault(doc, []).extend(_occurrences(words, x, template, containment, 2 * h, some.size))
                    doc += 1
    for doc, taken in found.items():
        coded = rows[doc].encode("utf-8", "surrogatepass")
        for share, x, y, name in _outer(taken):
            a, b = int(starts[x] - offsets[doc]), int(ends[y - 1] - offsets[doc])
            start = len(coded[:a].decode("utf-8", "surrogatepass"))
            out[doc].append((start, start + len(coded[a:b].decode("utf-8", "surrogatepass")), name, share))
    return out


def scan(docs: DataFrame, named: dict[str, str | tuple[str, ...]] | None = None, containment: float = CONTAINMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, license, start, end (code points), containment: a row for each match."""
    passes: list[dict[str, str | tuple[str, ...]]] = [{}]
    size = 0
    for name, text in (named or known()).items():
        own = len((text if isinstance(text, str) else "".join(text)).encode())
        if passes[-1] and size + own > pass_bytes:
            passes.append({})
            size = 0
        passes[-1][name] = text
        size += own

    def scanned(part: dict[str, str | tuple[str, ...]]) -> DataFrame:
        by_size(part)  # a bad template fails here and not in a task

        def run(batches):
            templates = by_size(part)
            for batch in batches:
                for piece in text_slices(batch, most=SLICE):
                    ids = piece.column("doc_id").to_pylist()
                    rows = [(d, *m) for d, ms in zip(ids, matches(texts(piece), templates, containment), strict=True) for m in ms]
                    yield of(FOUND, doc_id=[r[0] for r in rows], license=[r[3] for r in rows], start=[r[1] for r in rows], end=[r[2] for r in rows], containment=[r[4] for r in rows])

        return documents(docs).mapInArrow(run, FOUND_DDL)

    out = scanned(passes[0])
    for part in passes[1:]:
        out = out.unionByName(scanned(part))
    return out
