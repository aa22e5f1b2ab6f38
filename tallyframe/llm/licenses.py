"""Licence scans with DataFrame functions only.

A document is normalised to words, and its windows of consecutive words are compared with
licence templates by the Dice coefficient over word bigrams, repeats included:
2 x shared / (a + b). Where a text breaks its lines, what marks its comments and what stands
before or behind a licence does not matter.

A Dice of t needs sizes with a <= b x (2 - t) / t and the other way round. Each template is
compared with windows of some sizes within these bounds (all of a short template, steps of an
eighth of a long one); between two steps every size is tried whose bound, from what the larger
step shares, exceeds the best found. So the Dice is that of the best window of all sizes. A
document with fewer bigrams than the least size, or with fewer bigrams of the template than a
match needs, is left.

A bigram of the document that the template has ``k`` times counts in a window when fewer
than ``k`` of its kind stand before it there, so it counts for one run of window starts.
The best window of a document is the highest sum over these runs, found by one sorted pass:
no window is built and no pair of positions is compared.

Templates are a fixed small table and broadcast. No text is shuffled: only bigrams that some
template has are grouped by their document, and results are joined back to ids.

Defined results: null and empty texts, and texts without a match, have a null licence and
Dice 0; the best match is the highest Dice, then the first licence by name; repeated rows
get the same result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

MIN_DICE = 0.8
WORD = "[a-z0-9]+"

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_END = ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: Public licence notices, opening paragraphs and short licences as a whole.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THREE + _BSD_END),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_AS_IS}"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def size_bounds(n: int, min_dice: float) -> range:
    """Sizes of a passage that can reach min_dice with a template of n bigrams."""
    ratio = (2 - min_dice) / min_dice
    return range(max(1, math.ceil(n / ratio - 1e-9)), math.floor(n * ratio + 1e-9) + 1)


def step_sizes(n: int, min_dice: float) -> list[int]:
    """The sizes that are tried first: both ends, the template's own, and steps between."""
    every = size_bounds(n, min_dice)
    return sorted({n, every[-1], *every[:: max(1, n // 8)]})


def template_bigrams(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    w = re.findall(WORD, lowered)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def template_tables(spark: SparkSession, min_dice: float, texts: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, int]:
    """(gram, gram_id), one row for each bigram; (gram_id, template, license, n, k, sizes), one
    for each bigram of a template, k times in it; and the largest k."""
    grams = [(i, name, template_bigrams(text)) for i, (name, text) in enumerate(texts)]
    counts = [(i, name, len(g), Counter(g)) for i, name, g in grams if g]
    ids = {g: at for at, g in enumerate(sorted(set().union(*(c for *_, c in counts))))}
    uses = [(ids[g], i, name, n, k, step_sizes(n, min_dice)) for i, name, n, c in counts for g, k in c.items()]
    one = spark.createDataFrame(list(ids.items()), "gram string, gram_id int")
    return one, spark.createDataFrame(uses, "gram_id int, template int, license string, n int, k int, sizes array<int>"), max((u[4] for u in uses), default=0)


def hits(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text_key, size, p, gram_id: every bigram of a document that a template has."""
    split = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("w"))
    at = split.select("row", "doc_id", "text_key", "w", (F.size("w") - 1).alias("size"), F.posexplode("w").alias("p", "word")).filter(F.col("p") < F.col("size"))
    after = F.get("w", F.col("p") + 1)
    known = F.broadcast(grams.withColumns({"a": F.split_part("gram", F.lit(" "), F.lit(1)), "b": F.split_part("gram", F.lit(" "), F.lit(2))}).withColumn("key", F.xxhash64("a", "b")).drop("gram"))
    met = at.join(known, (F.xxhash64("word", after) == F.col("key")) & (F.col("word") == F.col("a")) & (after == F.col("b")))
    return met.select("row", "doc_id", "text_key", "size", "p", "gram_id")


def matches(docs: DataFrame, *, min_dice: float = MIN_DICE, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, license, template, dice: the best window for each size that reaches min_dice."""
    grams, uses, most = template_tables(docs.sparkSession, min_dice, TEMPLATES if texts is None else texts)
    by_row = hits(docs, grams, id_col, text_col).repartition(F.col("row"))
    own = by_row.join(F.broadcast(uses), "gram_id")
    inside = F.least(F.array_min("sizes"), F.col("size"))
    enough = F.count("*").over(Window.partitionBy("row", "template")) * 2 >= min_dice * (F.col("n") + inside) - 1e-9
    own = own.filter(F.col("size") >= F.array_min("sizes")).withColumn("enough", enough).filter("enough")
    kind = Window.partitionBy("row", "template", "gram_id").orderBy("p")
    # the k-th of the same kind before this one: windows that hold it have no room for this one
    before = F.coalesce(*(F.when(F.col("k") == k, F.lag("p", k).over(kind)) for k in range(1, most + 1)), F.lit(-1)) if most else F.lit(-1)
    own = written(own.withColumn("before", before).drop("enough"), "license-hits")
    steps = written(_shared(own.withColumn("s", F.explode(F.array_distinct(F.transform("sizes", lambda s: F.least(s, F.col("size"))))))), "license-steps")
    # a window within one of size s2 shares no more than the best of that size, nor more than its own size
    by = Window.partitionBy("row", "template")
    s1, dice = F.lag("s").over(by.orderBy("s")), 2.0 * F.col("shared") / (F.col("n") + F.col("s"))
    gaps = steps.withColumns({"s1": s1, "top": F.max(dice).over(by)}).filter(F.col("s") - F.col("s1") > 1)
    best_size = F.greatest(F.col("s1") + 1, F.least(F.col("shared").cast("int"), F.col("s") - 1))
    bound = 2.0 * F.least(F.col("shared"), best_size) / (F.col("n") + best_size)
    open_gaps = gaps.filter((bound >= min_dice) & (bound > F.col("top"))).select("row", "template", F.explode(F.sequence(F.col("s1") + 1, F.col("s") - 1)).alias("s"))
    more = _shared(own.join(open_gaps, ["row", "template"]))
    return steps.unionByName(more).withColumn("dice", dice).filter(F.col("dice") >= min_dice).select("doc_id", "text_key", "license", "template", "dice")


def _shared(sized: DataFrame) -> DataFrame:
    """Of hits with a window size s: the most that a window of that size shares, by row and template."""
    first = F.greatest(F.col("before") + 1, F.col("p") - F.col("s") + 1, F.lit(0))
    last = F.least("p", F.col("size") - F.col("s"))
    runs = sized.withColumns({"first": first, "last": last}).filter("first <= last")
    key = ["row", "doc_id", "text_key", "template", "license", "n", "s"]
    edges = runs.select(*key, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*key, "e.*")
    steps = edges.groupBy(*key, "at").agg(F.sum("d").alias("d"))
    sums = steps.withColumn("shared", F.sum("d").over(Window.partitionBy("row", "template", "s").orderBy("at")))
    return sums.groupBy(*key).agg(F.max("shared").alias("shared"))


def scan(docs: DataFrame, *, min_dice: float = MIN_DICE, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (the best, or null), dice, n_licenses for every document."""
    found = matches(docs, min_dice=min_dice, texts=texts, id_col=id_col, text_col=text_col)
    best = found.groupBy("doc_id", "text_key").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"), F.count_distinct("license").alias("n_licenses"))
    best = best.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"), "n_licenses")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    joined = ids.join(best, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    return joined.select("doc_id", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"))
