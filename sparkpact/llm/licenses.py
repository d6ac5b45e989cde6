"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Everything on the main path is a DataFrame function. A document becomes overlapping chunks of
words, a chunk its five-word shingles (as 64-bit hashes), and these overlapping windows of the
sizes in SCALES. A template is cut into windows of the size of its scale at every offset, so
that a copy of it, wherever it stands, meets one of them with at least the similarity of
least_similarity(). Windows are looked up by their bands, which retrieves (document, license)
pairs; a pair is verified over the whole document: a template is reported if the document,
wherever they stand in it, holds at least ``containment`` of its shingles.

Bands are a matter of chance for copies that are changed, so windows of one shingle retrieve too:
a document with that share of a template's shingles has one of any so many of them that the rest
is less than the share. Nothing that verification would report is missed.

The k-th MinHash permutation is h -> h XOR c_k: the shingle nearest to c_k is any of a set's
with equal chance, since the hashes are random. A band is one such minimum.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Shingles that begin in a chunk; bounds the arrays of one row.
CHUNK = 4_096
#: Characters of templates whose bands are broadcast at once.
PASS_CHARS = 1_000_000


#: Shingles from one row of windows to the next, and those that a row's windows reach over.
STEP, REACH = 4, 8


@dataclass(frozen=True)
class Scale:
    """Windows of size shingles, every stride shingles, with so many bands, for templates of so many shingles at least."""

    size: int
    stride: int
    bands: int
    least: int


SCALES = (Scale(1, 1, 1, 1), Scale(4, 2, 6, 2), Scale(8, 4, 4, 9))

# Notices, opening passages and full terms of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

NO_WORD = r"[^\p{L}\p{N}]+"


def collision_probability(similarity: float, bands: int) -> float:
    """Chance that two sets of this Jaccard similarity share one of so many bands of one row."""
    return 1 - (1 - similarity) ** bands


def scale_of(shingles: int) -> Scale:
    return max((s for s in SCALES if s.least <= shingles), key=lambda s: s.least)


def least_similarity(shingles: int) -> float:
    """Least Jaccard similarity that some window of a document with a whole copy of a template has
    to one of the template's windows, wherever the copy begins."""
    s = scale_of(shingles)
    if shingles >= s.size + s.stride - 1:
        return 1.0  # one window lies within the copy
    # the best of all windows, for the worst place of the copy on the grid
    worst = 1.0
    for start in range(s.stride):
        best = 0.0
        for window in range(0, start + shingles, s.stride):
            if window + s.size > start:
                common = min(window + s.size, start + shingles) - max(window, start)
                best = max(best, common / (s.size + min(s.size, shingles) - common))
        worst = min(worst, best)
    return worst


def masks(bands: int) -> list[int]:
    """Fixed, well-spread values of c_k."""
    x = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return [int(v) for v in x.view(np.int64)]


def hashes_sql(text: str) -> str:
    """Array of the 64-bit hashes of a text's words: runs of letters and digits, in lower case."""
    words = f"array_remove(split(lower({text}), '{NO_WORD}'), '')".replace("\\", "\\\\")
    return f"transform({words}, w -> xxhash64(w))"


def shingles_sql(hashes: str) -> str:
    """Hashes of an array's shingles, in order, from its words' hashes."""
    parts = ", ".join(f"get({hashes}, i + {k})" for k in range(SHINGLE))
    return f"if(size({hashes}) < {SHINGLE}, array(), transform(sequence(0, size({hashes}) - {SHINGLE}), i -> xxhash64({parts})))"


def band_keys(window: list[Column], scale: int) -> list[Column]:
    """A key for each band: its minimum, marked by the scale. Missing shingles (null) do not count."""
    mark = F.lit(masks(len(SCALES) + 64)[64 + scale])
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    return [least([h.bitwiseXOR(F.lit(m)) for h in window]).bitwiseXOR(F.lit(m)).bitwiseXOR(mark) for m in masks(SCALES[scale].bands)]


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles): distinct shingle hashes. Templates shorter than a shingle are refused."""
    for name, text in templates.items():
        if len([w for w in re.split(r"[\W_]+", text) if w]) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return rows.select("license", F.expr(hashes_sql("text")).alias("hashes")).select("license", F.expr(shingles_sql("hashes")).alias("ordered"))


def template_bands(table: DataFrame, containment: float) -> DataFrame:
    """(band, license, n_shingles, counts, retrieves): a key for each shingle, which counts, and
    those of the bands of every window at every offset, which retrieve. So do the keys of the first
    shingles, one more than a document may lack."""
    single = table.select("license", F.array_distinct("ordered").alias("wanted")).withColumn("n_shingles", F.size("wanted"))
    parts = [
        single.select("license", "n_shingles", F.posexplode("wanted").alias("k", "shingle")).select(
            band_keys([F.col("shingle")], 0)[0].alias("band"), "license", "n_shingles", F.lit(True).alias("counts"), (F.col("k") <= F.col("n_shingles") - F.floor(F.lit(containment) * F.col("n_shingles"))).alias("retrieves")
        )
    ]
    for k, s in list(enumerate(SCALES))[1:]:
        nxt = SCALES[k + 1].least if k + 1 < len(SCALES) else 1 << 30
        own = table.where(F.size("ordered").between(s.least, nxt - 1))
        at = own.select("license", "ordered", F.explode(F.expr(f"sequence(0, greatest(0, size(ordered) - {s.size}))")).alias("at"))
        keys = F.array(*band_keys([F.get("ordered", F.col("at") + x) for x in range(s.size)], k))
        parts.append(at.select(F.explode(keys).alias("band"), "license", F.size(F.array_distinct("ordered")).alias("n_shingles"), F.lit(False).alias("counts"), F.lit(True).alias("retrieves")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def windows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for every STEP shingles: id, w0 to w11 (the hashes of the words from there on) and
    place (the number of the first)."""
    span = REACH + SHINGLE - 1
    hashed = docs.select(F.col(id_col).alias("id"), F.expr(hashes_sql(f"coalesce(`{text_col}`, '')")).alias("hashes")).where(f"size(hashes) >= {SHINGLE}")
    # chunks overlap by what a row looks at after its own
    chunk = f"struct(c * {CHUNK} AS at, slice(hashes, c * {CHUNK} + 1, {CHUNK + span}) AS hashes)"
    chunks = hashed.select("id", F.explode(F.expr(f"transform(sequence(0, (size(hashes) - {SHINGLE}) div {CHUNK}), c -> {chunk})")).alias("c")).select("id", "c.at", "c.hashes")
    words = ", ".join(f"get(hashes, p + {k}) AS w{k}" for k in range(span))
    last = f"least({CHUNK}, size(hashes) - {SHINGLE - 1}) - 1"
    return chunks.select("id", F.explode(F.expr(f"transform(sequence(0, {last}, {STEP}), p -> struct({words}, at + p AS place))")).alias("w")).select("id", "w.*")


def keys_of_row() -> tuple[Column, Column]:
    """Keys of all windows that begin in a row's STEP shingles: those of its single shingles in
    order, and those of larger windows. Where the text ends, words that are not there leave shingles of fewer words, which no
    template has."""
    word = [F.col(f"w{k}") for k in range(REACH + SHINGLE - 1)]
    shingle = [F.xxhash64(*word[k : k + SHINGLE]) for k in range(REACH)]
    keys = []
    for k, s in list(enumerate(SCALES))[1:]:
        for start in range(0, STEP, s.stride):
            keys += band_keys(shingle[start : start + s.size], k)
    return F.array(*(band_keys([h], 0)[0] for h in shingle[:STEP])), F.array(*keys)


def passes(templates: dict[str, str]) -> list[dict[str, str]]:
    """Templates in runs of at most PASS_CHARS characters (or of one template)."""
    out: list[dict[str, str]] = []
    size = 0
    for name, text in sorted(templates.items()):
        if not out or size + len(text) > PASS_CHARS:
            out.append({})
            size = 0
        out[-1][name] = text
        size += len(text)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses found in whole documents.

    Returns a row for each row of docs and license found: id_col, license, n_shingles, n_found,
    containment double, first_word and last_word (0-based, of the hits).

    Templates come from code; the bands of at most PASS_CHARS characters of them are broadcast at
    once, more take several passes. Null and empty texts and texts of fewer than five words: no row.
    Rows stand for themselves, whatever their id: rows of one id, or of none, are scanned one by
    one. No templates or empty table: empty result. Other columns are not read.
    """
    numbered = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("scan_row"))
    out = None
    for some in passes(TEMPLATES if templates is None else templates) or [{}]:
        found = scan_pass(numbered, some, containment, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def scan_pass(numbered: DataFrame, templates: dict[str, str], containment: float, id_col: str, text_col: str) -> DataFrame:
    """scan() by one run of templates. The rows' numbers are used within one pass over them only."""
    bands = template_bands(template_table(numbered.sparkSession, templates), containment)
    single, larger = keys_of_row()
    key = F.struct(F.col(id_col).alias("id"), F.col("scan_row").alias("row"))
    # a step of its own: what keys have in common is computed once in a projection, not in a generator
    keyed = windows_of(numbered.select(key.alias("key"), text_col), "key", text_col).select("id", "place", single.alias("single"), larger.alias("larger"))
    keyed = keyed.select("id", "place", F.posexplode(F.concat("single", F.array_distinct("larger"))).alias("k", "band"))
    hits = keyed.join(F.broadcast(bands), "band").select("id", "license", "n_shingles", "retrieves", F.expr("if(counts, band, null)").alias("shingle"), F.expr("if(counts, place + k, null)").alias("word"))
    each = hits.groupBy("id", "license", "n_shingles", "shingle").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("retrieves").alias("retrieves"))
    found = each.groupBy("id", "license", "n_shingles").agg(F.count("shingle").alias("n_found"), F.min("low").alias("first_word"), (F.max("high") + SHINGLE - 1).alias("last_word"), F.max("retrieves").alias("retrieved")).where("retrieved AND n_found > 0")
    share = F.col("n_found") / F.col("n_shingles")
    return found.where(share >= containment).select(F.col("id.id").alias(id_col), "license", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"), share.alias("containment"), F.col("first_word").cast("long"), F.col("last_word").cast("long"))
