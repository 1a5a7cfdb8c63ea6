"""License scans with DataFrame functions only.

A text's words form shingles of five.  Overlapping windows of shingles get MinHash signatures of ``BANDS`` bands of one
row; a join on (band, hash) with the signatures of the templates retrieves templates, and exact containment verifies
them: at least 0.8 of a template's shingles lie in the window.

Windows come in sizes of powers of two.  A template belongs to the size that is twice to four times its number m of
shingles; windows are half a size apart, so each occurrence of up to half a size lies whole in one.  A window of a size
counts only shingles that a Bloom filter takes for shingles of that size's templates: all others can't take part
in a match.  A match holds 0.8 m shingles of the template in a window of at most 4 m, so its Jaccard similarity is
0.8 m / (4 m + 0.2 m) = 0.19 or more even where templates fill the whole window, and a band of one row collides with
that probability: a match is missed with probability (1 - 0.19)^BANDS, under 5e-5, and under 1e-30 where the window
holds one template only (0.8 or more).

Everything up to the verified windows happens within a row; only these are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 48
#: Rows of the template bands up to which the join broadcasts them.
BROADCAST_BANDS = 200_000
#: Texts and notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation""",
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
WORDS = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hash of each five words in a row; no shingle in shorter texts."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def _signature(shingles: Column) -> Column:
    """MinHash of a shingle set: a value for each band, with the band in it."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))), b))


def _once(value: Column) -> Column:
    """``value``, computed once: the generator keeps the optimiser from copying it into each lambda that reads it."""
    return F.explode(F.array(value))


def window_size(n_shingles: int) -> int:
    """Windows come in sizes of powers of two; the least one of twice the template's shingles or more."""
    return 1 << (2 * n_shingles - 1).bit_length()


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> list[tuple[str, int, list[int], list[int]]]:
    """(name, window size, shingles, signature) of each template: a list fixed by the caller, computed with the same
    expressions as the documents."""
    short = [k for k, v in templates.items() if len(re.findall(r"[^\W_]+", v)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    df = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", _once(_words(F.col("text"))).alias("w"))
    df = df.select("name", _once(F.array_distinct(_shingles(F.col("w")))).alias("s")).withColumn("sig", _signature(F.col("s")))
    return [(r["name"], window_size(len(r["s"])), r["s"], r["sig"]) for r in df.orderBy("name").collect()]


class _Bits:
    """A Bloom filter of two hashes as an array literal, 64 bits or more for each shingle: it takes one of a thousand
    other shingles for one of its own."""

    def __init__(self, shingles: set[int]):
        self.mask = (1 << max(10, (64 * len(shingles)).bit_length())) - 1
        words = [0] * ((self.mask + 1) >> 6)
        for s in shingles:
            for at in (s & self.mask, (s >> 32) & self.mask):
                words[at >> 6] |= 1 << (at & 63)
        self.words = F.lit([w - (1 << 64) if w >> 63 else w for w in words]).cast("array<bigint>")

    def _bit(self, x: Column) -> Column:
        at = x.bitwiseAND(F.lit(self.mask).cast("long"))
        word = F.get(self.words, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    def holds(self, x: Column) -> Column:
        return self._bit(x) & self._bit(F.shiftright(x, 32))

    def among(self, hits: str) -> Column:
        return F.filter(hits, lambda x: self.holds(x["s"]))


def _windows(hits: Column, size: int) -> Column:
    """Each hit in the two windows of ``size`` shingles, half of it apart, that hold it: size, start and shingle."""
    stride = max(size // 2, 1)
    at = lambda x: F.call_function("div", x["p"], F.lit(stride)).cast("int")
    one = lambda w, x: F.struct(F.lit(size).alias("size"), (w * stride).alias("start"), x["s"].alias("s"))
    return F.filter(F.flatten(F.transform(hits, lambda x: F.array(one(at(x), x), one(at(x) - 1, x)))), lambda w: w["start"] >= 0)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, license, containment, n_windows, first_word)``, a row for each license found.

    ``containment`` is the largest of the windows that match.  Null, empty and short texts hold no license; each row of
    ``docs`` has its own results, so repeated rows repeat them and different texts under one id, or under none, stay
    apart; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    every = _Bits({s for _, _, shingles, _ in known for s in shingles})
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", _once(_words(F.col("text"))).alias("w")).select("doc_id", "text", _once(_shingles(F.col("w"))).alias("h"))
    hits = F.array_compact(F.transform("h", lambda x, i: F.when(every.holds(x), F.struct(x.alias("s"), i.alias("p")))))
    rows = rows.select("doc_id", "text", _once(hits).alias("hits")).filter(F.size("hits") > 0)
    # rows are told apart by id and text; those that repeat both are one, with their number
    rows = rows.groupBy("doc_id", F.md5("text").alias("digest")).agg(F.count("*").cast("int").alias("copies"), F.first("hits").alias("hits"))
    wins = []
    for size in sorted({size for _, size, _, _ in known}):
        wins.append(_windows(_Bits({s for _, n, shingles, _ in known if n == size for s in shingles}).among("hits"), size))
    row = ["doc_id", "digest", "copies"]
    wins = rows.select(*row, F.explode(F.concat(*wins)).alias("win")).groupBy(*row, "win.size", "win.start").agg(F.array_sort(F.collect_set("win.s")).alias("s"))
    # windows of a row with the same shingles are probed once
    sets = wins.groupBy(*row, "size", "s").agg(F.count("*").alias("n_windows"), F.min("start").alias("start"))
    probes = sets.select(*row, "size", "start", "n_windows", "s", F.posexplode(_signature(F.col("s"))).alias("band", "hash"))
    bands = spark.createDataFrame([(name, size, band, h, shingles) for name, size, shingles, sig in known for band, h in enumerate(sig)], "license string, size int, band int, hash long, own array<bigint>")
    if len(known) * BANDS <= BROADCAST_BANDS:
        bands = F.broadcast(bands)
    share = F.size(F.array_intersect("s", "own")) / F.size("own")
    met = probes.join(bands, ["band", "hash", "size"]).select(*row, "license", "start", "n_windows", share.alias("containment")).filter(F.col("containment") >= CONTAINMENT)
    # several bands retrieve the same template
    each = met.distinct()
    found = each.groupBy(*row, "license").agg(F.max("containment").alias("containment"), F.sum("n_windows").alias("n_windows"), F.min("start").cast("int").alias("first_word"))
    return found.select("doc_id", "license", "containment", "n_windows", "first_word", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL of the exact containment, without MinHash retrieval."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(license, text)),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s
       FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)),
tn AS (SELECT license, count(*) AS m, CAST(pow(2, ceil(log2(2 * count(*)))) AS BIGINT) AS size FROM ts GROUP BY 1),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
dp AS (SELECT r, doc_id, i - 1 AS p, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s
       FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw)),
hit AS (SELECT r, doc_id, license, m, size, p, s FROM dp JOIN ts USING (s) JOIN tn USING (license)),
win AS (SELECT r, doc_id, license, m, size, s, p // (size // 2) AS w FROM hit
        UNION ALL SELECT r, doc_id, license, m, size, s, p // (size // 2) - 1 FROM hit),
c AS (SELECT r, doc_id, license, w * (size // 2) AS start_at, count(DISTINCT s) / m AS containment
      FROM win WHERE w >= 0 GROUP BY r, doc_id, license, w, size, m)
SELECT doc_id, license, max(containment) AS containment, count(DISTINCT start_at) AS n_windows, CAST(min(start_at) AS INTEGER) AS first_word
FROM c WHERE containment >= {CONTAINMENT} GROUP BY r, doc_id, license"""
