"""License notices: MinHash bands over overlapping windows, then exact containment.

Notices are a table of texts. Texts and notices are word 5-shingles; a shingle of a text
that no notice has can neither be in a match nor agree with one, so it is left out and the
rest keep their places. A notice of S shingles belongs to a window width, the largest of ``WIDTHS``
of which a window at every ``step`` must lie within it. The windows of a text overlap (each place is in ``w / step`` of
them); a notice has one at every place. A window's signature is ``BANDS`` bands of ``ROWS`` minima
each, and windows that agree in all rows of some band retrieve the notice: at a Jaccard similarity J with probability
``1 - (1 - J^ROWS)^BANDS`` a window, 0.997 for 0.75, 0.984 for 0.65, and a notice has many windows; a window
of it that is unaltered in the text agrees for sure. Retrieved notices are verified by the exact
share of their distinct shingles that the whole text holds (``CONTAINED`` or more).

Everything is DataFrame expressions; no Python runs on executors. Texts go in
pieces of ``PIECE`` words; shingles of a text that meet a notice's are stored once (place, shingle and
notice), windows are minima by group, which every task pre-aggregates, and
retrieved pairs meet the stored rows again. The notices' shingles and band keys are broadcast up to
``BROADCAST_KEYS`` rows, else joined by a shuffle, where adaptive execution splits frequent ones.

Defined cases: null texts and texts under five words hold no notice, a notice
under five words is never found, long notices have more windows; rows with one doc_id (null too) report together, each text judged by itself;
repeated matches of a license give one row; other columns are ignored; a very long
text is split into words as one array; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SHINGLE = 5
BANDS, ROWS = 12, 2
#: Window widths and the distance of a text's windows.
WIDTHS = ((1, 1), (4, 1), (16, 8))
CONTAINED = 0.75
PIECE = 1 << 14
#: Rows of shingles or band keys (about 24 bytes) that may be broadcast.
BROADCAST_KEYS = 1_000_000

# Notice texts by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
]


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def placed_shingles(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, at, h): the hash of every word 5-shingle of a text and the word where it begins."""
    words = rows.select(*keys, words_of(F.col(text)).alias("ws")).where(F.size("ws") >= SHINGLE)
    numbers = F.sequence(F.lit(0), F.floor((F.size("ws") - SHINGLE) / PIECE).cast("int"))
    pieces = words.select(*keys, F.explode(F.transform(numbers, lambda i: F.struct((i * PIECE).alias("off"), F.slice("ws", i * PIECE + 1, F.lit(PIECE + SHINGLE - 1)).alias("ws")))).alias("p")).select(*keys, "p.off", "p.ws")
    each = F.transform(F.sequence(F.lit(0), F.size("ws") - SHINGLE), lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(SHINGLE)]))
    return pieces.select(*keys, "off", F.posexplode(each).alias("i", "h")).select(*keys, (F.col("off") + F.col("i")).alias("at"), "h")


def _mask(n: int) -> Column:
    """An order of hashes: by their distance (exclusive or) to a constant, so the least is a random member."""
    return F.lit((n + 1) * 0x9E3779B97F4A7C15 % 2**63)


def signatures(members: DataFrame, window: list[str]) -> DataFrame:
    """(window, key): a key for each band of every window of (window, h); ``w`` is among the window's columns."""
    least = members.groupBy(*window).agg(*[F.min(F.col("h").bitwiseXOR(_mask(n))).alias(f"m{n}") for n in range(BANDS * ROWS)])
    keys = [F.xxhash64(F.lit(b), "w", *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return least.select(*window, F.explode(F.array(*keys)).alias("key"))


def text_windows(at: Column, w: Column) -> Column:
    """Where the windows of width ``w`` begin that a place of a text is in."""
    starts = lambda width, step: F.array(*[(F.floor(at / step) - i) * step for i in range(width // step)])
    return F.coalesce(*[F.when(w == width, starts(width, step)) for width, step in WIDTHS])


def notice_tables(notices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (license, text): (notice, license, n) with the number of distinct shingles, (notice, w, h), and (key, notice) of the windows at every place."""
    own = stored(placed_shingles(notices.where("text IS NOT NULL").withColumn("notice", F.xxhash64("license", words_of(F.col("text")))), "text", ["notice", "license"]).distinct(), "license-shingles")
    facts = own.groupBy("notice", "license").agg(F.countDistinct("h").alias("n"), (F.max("at") + 1).alias("size"))
    width = F.coalesce(*[F.when(F.col("size") >= w + step - 1, F.lit(w)) for w, step in reversed(WIDTHS)])
    facts = facts.select("notice", "license", "n", "size", width.alias("w"))
    sized = own.join(facts.select("notice", "size", "w"), "notice")
    starts = F.sequence(F.greatest(F.col("at") - F.col("w") + 1, F.lit(0)), F.least(F.col("at"), F.col("size") - F.col("w")))
    keys = signatures(sized.select("notice", "w", "h", F.explode(starts).alias("start")), ["notice", "w", "start"]).select("key", "notice").distinct()
    return facts.select("notice", "license", "n"), sized.select("notice", "w", "h").distinct(), keys


def notice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def _sent(table: DataFrame) -> DataFrame:
    """Broadcast behind a count, else joined by a shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else table.hint("merge")


def license_matches(docs: DataFrame, doc_id="doc_id", text="text", notices: DataFrame | None = None) -> DataFrame:
    """doc_id, license, containment (best), position (word of the first shared shingle from the first agreeing window on)."""
    facts, own, keys = (stored(t, "license-notices") for t in notice_tables(notice_table(docs.sparkSession) if notices is None else notices))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("t"))
    met = stored(placed_shingles(rows, "text", ["doc_id", "t"]).join(_sent(own), "h"), "license-met")
    members = met.select("doc_id", "t", "w", "h", F.explode(text_windows(F.col("at"), F.col("w"))).alias("start"))
    agreed = signatures(members, ["doc_id", "t", "w", "start"]).join(_sent(keys), "key")
    found = agreed.groupBy("doc_id", "t", "notice").agg(F.min("start").alias("start"))
    same = F.col("m.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("m.t") == F.col("f.t")) & (F.col("m.notice") == F.col("f.notice"))
    held = met.alias("m").join(found.alias("f"), same).groupBy("f.doc_id", "f.t", "f.notice").agg(F.countDistinct("h").alias("shared"), F.min(F.when(F.col("at") >= F.col("start"), F.col("at"))).alias("at"))
    whole = held.join(_sent(facts), "notice").withColumn("containment", F.col("shared") / F.col("n")).where(F.col("containment") >= CONTAINED)
    return whole.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("position"))
