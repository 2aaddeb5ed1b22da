"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Everything is DataFrame functions. Words are runs of ASCII letters and digits in lower case; a shingle
is SHINGLE consecutive words, a hash of them. A template belongs to the smallest block size (BLOCK shingles,
doubled) that is no less than its shingles; a text's windows of that size are two such blocks, one block
apart, so any passage of a template's length lies whole in some window. A window is sketched by the
MinHash of all its shingles in each of BANDS bands. Each band that equals a template's retrieves it.

Not every window has to be sketched: if a band's MinHash is a template's, then the shingle that has it is in
the window. Windows that hold no such shingle of any template share no band, and are left out before.

How likely: a template of n shingles, of which a share c = CONTAINMENT is in a window of 2 s shingles
(s / 2 < n <= s), has a similarity of c n / (2 s + (1 - c) n) or more, which is 0.19 at least; it shares a
band with probability 1 - (1 - 0.19)^48 = 0.99996 then, and more than that for n near s or c near 1. Candidates are
verified: the share of the template's distinct shingles that the window has must reach CONTAINMENT.

Templates are a parameter, of any number and length. Their bands are broadcast in blocks of at most BROADCAST
rows; more blocks pass over the documents one after another. Null and empty texts match nothing; a document with a template
in several places has one row for it, with the best containment and the earliest place of one of its
shingles in a matching window; rows that repeat a doc_id count as one document; templates of fewer than
SHINGLE words can't match; a text that holds a template within another is reported for both; an
empty table gives no rows; columns other than id and text play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import two_columns

SHINGLE, BANDS, CONTAINMENT = 3, 48, 0.8
#: Shingles of the smallest blocks; larger ones double.
BLOCK = 4
#: Bands of templates that are broadcast together at most.
BROADCAST = 2_000_000

#: Notices that authors are asked to place in their works, and whole short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def level_of(words: list[str], shingle: int = SHINGLE) -> int:
    """How often blocks double until a template's shingles fit into one."""
    level = 0
    while BLOCK << level < len(words) - shingle + 1:
        level += 1
    return level


def shingle_hashes(words: Column, size: int) -> Column:
    """The hash of each run of `size` words, by position. The words are bound once: wherever the plan puts this, they are made once a row."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    return F.get(F.transform(F.array(words), runs), 0)


def sketch(hashes: Column, bands: int) -> Column:
    """The MinHash of each band, and the shingle that has it."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, b).alias("low"), h.alias("h")))))


def window(hashes: Column, start: Column, size: Column) -> Column:
    """Shingles from start on; by places, since a slice would cost the length of the whole text."""
    return F.transform(F.sequence(start, F.least(start + size, F.size(hashes)) - 1), lambda i: F.get(hashes, i))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document and template in it: doc_id, license, containment (best), first_word (earliest place of one of its shingles where it matches)."""
    given = [(name, w, level_of(w, shingle)) for name, t in templates.items() if len(w := words_of(t)) >= shingle]
    # ascii lower case before anything else: other letters are never part of a word
    plain = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
    rows = two_columns(docs, id_col, text_col).select("doc_id", F.split(plain, " ").alias("words")).select("doc_id", shingle_hashes(F.col("words"), shingle).alias("shingles"))
    step, found = max(1, BROADCAST // bands), None
    for at in range(0, max(1, len(given)), step):
        some = retrieved(rows, given[at : at + step], shingle, bands, containment)
        found = some if found is None else found.unionByName(some)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word"))


def retrieved(rows: DataFrame, given: list[tuple[str, list[str], int]], shingle: int, bands: int, containment: float) -> DataFrame:
    """doc_id, license, containment and first of the windows that hold a template of one block."""
    known = rows.sparkSession.createDataFrame(given, "license string, words array<string>, level int")
    known = known.select("license", "level", F.array_distinct(shingle_hashes(F.col("words"), shingle)).alias("wanted"))
    keys = known.select("license", F.col("level").alias("of"), "wanted", F.posexplode(sketch(F.col("wanted"), bands)).alias("band", "key"))
    marks = keys.select(F.col("key.h").alias("h"), F.col("of").alias("level")).distinct()  # the shingles that have a band of a template
    size = (BLOCK * F.pow(F.lit(2.0), "level")).cast("int")
    # outer: no filter is inferred that would make the shingles a second time
    hits = rows.select("doc_id", "shingles", F.posexplode_outer("shingles").alias("place", "h")).join(F.broadcast(marks), "h")
    hits = hits.select("doc_id", "shingles", "level", F.explode(F.array(F.floor(F.col("place") / size) - 1, F.floor(F.col("place") / size))).alias("at")).where("at >= 0")
    start = (F.col("at") * size).cast("int")
    windows = hits.select("doc_id", "level", start.alias("start"), window(F.col("shingles"), start, 2 * size).alias("have")).distinct()
    banded = windows.select("*", F.posexplode(sketch(F.array_distinct("have"), bands)).alias("band", "key"))
    same = (F.col("band") == F.col("kband")) & (F.col("low") == F.col("klow")) & (F.col("level") == F.col("of"))
    banded = banded.select("doc_id", "level", "start", "have", "band", F.col("key.low").alias("low"))
    found = banded.join(F.broadcast(keys.select("license", "of", "wanted", F.col("band").alias("kband"), F.col("key.low").alias("klow"))), same)
    found = found.withColumn("containment", F.size(F.array_intersect("have", "wanted")) / F.size("wanted")).where(F.col("containment") >= containment)
    first = F.col("start") + F.array_min(F.transform("wanted", lambda x: F.nullif(F.array_position("have", x), F.lit(0)))) - 1
    return found.select("doc_id", "license", "containment", first.alias("first"))
