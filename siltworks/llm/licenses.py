"""License scans: MinHash retrieval of templates over text windows, then exact containment.

Words are runs of letters and digits (ASCII lower-cased, other bytes kept);
shingles are five words. At block sizes 1, 2, 4, ... a text's shingles are cut
into blocks, and every two neighbouring blocks form a window, so windows
overlap by half and any run of at most B shingles lies inside one window of 2 B.
A template of m shingles is searched at the smallest block size B >= m, which is
under 2 m, so a window has fewer than 4 m shingles.

A window that holds ``CONTAINMENT`` of a template's shingles has a resemblance
of more than 0.8 m / (4 m + 0.2 m) = 0.19 with it. ``BANDS`` bands of one MinHash
row each miss such a pair with a probability under 0.81 ** 64 < 2e-6. What is
retrieved is verified on the shingles themselves, not their hashes: the exact
share of the template's distinct shingles in the window.

Defined cases: null or short texts match nothing; a template of fewer than five
words has no shingle and is refused; of several windows with one template, the
highest containment counts, then the first; null ids and repeated rows are
scanned as they are; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SHINGLE, CONTAINMENT, BANDS, SEED = 5, 0.8, 64, 3
#: Shingles hashed at a time: 64 bands of them are 2 MB.
STEP = 1 << 12
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Public notices that texts carry, in full where they are short, else the part that names the license.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-section": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LETTERS).split()


def shingles(words: list[bytes], begin: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The shingles that start at the words from ``begin`` to before ``end``."""
    stop = max(begin, len(words) - SHINGLE + 1 if end is None else end)
    return map(b" ".join, zip(*(words[begin + i : stop + i] for i in range(SHINGLE))))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(words)), np.uint64, max(0, len(words) - SHINGLE + 1))


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, bands: int = BANDS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.bands = bands
        self.mul = rng.integers(0, 2**63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, bands, np.uint64)
        self.names = list(templates)
        listed = [words_of(t) for t in templates.values()]
        self.sets = [set(shingles(w)) for w in listed]
        if not all(self.sets):
            raise ValueError(f"a template needs {SHINGLE} words or more")
        #: Of each block size: templates by (band, value), and which leading bits of values any of them has.
        self.rows: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.seen: dict[int, np.ndarray] = {}
        for i, (words, some) in enumerate(zip(listed, self.sets)):
            size = 1 << (len(some) - 1).bit_length()
            least = (np.unique(hashes_of(words))[:, None] * self.mul + self.add).min(axis=0)
            for band, value in enumerate(least.tolist()):
                self.rows.setdefault(size, {}).setdefault((band, value), []).append(i)
            self.seen.setdefault(size, np.zeros(1 << 20, bool))[least >> np.uint64(44)] = True
        self.levels = max(self.rows).bit_length()

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, begin, end) of windows that share a band with a template; shingle positions."""
        n = len(hashes)
        reach = 2 << (self.levels - 1)
        for at in range(0, max(n, 1), STEP):
            part = hashes[at : at + STEP + reach]  # a window never reaches further
            if not len(part):
                return
            found: set[tuple[int, int, int]] = set()
            least, size = part[None, :] * self.mul[:, None] + self.add[:, None], 1
            for _ in range(self.levels):
                if size in self.rows:
                    window = np.minimum(least[:, :-1], least[:, 1:]) if least.shape[1] > 1 else least
                    rows = self.rows[size]
                    bands, places = np.nonzero(self.seen[size][window >> np.uint64(44)])
                    for band, w, value in zip(bands.tolist(), places.tolist(), window[bands, places].tolist()):
                        found.update((i, size, w) for i in rows.get((band, value), ()))
                if least.shape[1] % 2:
                    least = np.concatenate([least, least[:, -1:]], axis=1)
                least, size = np.minimum(least[:, ::2], least[:, 1::2]), 2 * size
            for i, size, w in sorted(found):
                if w * size < STEP:
                    yield i, at + w * size, min(n, at + (w + 2) * size)

    def scan(self, text: str, least: float = CONTAINMENT) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words) of the best window of each template found."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for i, begin, end in self.candidates(hashes_of(words)):
            here = list(shingles(words, begin, end))
            inside = [k for k, shingle in enumerate(here) if shingle in self.sets[i]]
            share = len({here[k] for k in inside}) / len(self.sets[i])
            if share < least:
                continue
            span = (share, -(begin + inside[0]), inside[-1] - inside[0] + SHINGLE)
            best[i] = max(best.get(i, span), span)
        return [(self.names[i], share, -first, words) for i, (share, first, words) in sorted(best.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word, words): one row per text and template found."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kept = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kept)
        for batch in batches:
            place, found = [], []
            for i, x in enumerate(batch.column(1)):
                for hit in scanner.scan(x.as_py(), least):
                    place.append(i)
                    found.append(hit)
            name, share, first, words = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(words, pa.int64())], ["id", "license", "containment", "first_word", "words"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, license string, containment double, first_word long, words long")
    return found.withColumnRenamed("id", id_col)
