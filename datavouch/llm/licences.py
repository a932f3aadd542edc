"""Licence scan: Dice coefficient over word bigrams against templates, in DataFrame operations only.

A text is normalised (A-Z lower-cased, runs of other ASCII characters than digits and letters become
one space, line ends too) and cut into words; its bigrams are looked up in the templates' postings.
A template of b bigrams needs at least b t / (2 - t) of them for a coefficient of t, which most
templates fail at once. For the others the best place is sought: against the threshold, each of a
template's bigrams is worth 2 - t once in a place and any other costs t. A place that starts amid
neighbouring bigrams of the template is never better than one that also takes those before, so only
the first of each such island is a start; and as b bigrams pay for (2 - t) b / t others, a start needs
to look no farther. Starts meet the bigrams in their reach by ranges of that length, and a running
sum finds the best end. The coefficient of the best place then decides, whatever else the text holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datavouch.functions.tables import SENT_ROWS
from datavouch.llm.common import ascii_lower, saved

# Licence notices and short licence texts in their public wording.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# End of the fixed values.

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of all templates together; they go to every task.
MOST_CHARS = 16_000_000


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, normalised as ``scan`` does."""
    words = re.sub(_OTHER, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split(" ")
    words = [w for w in words if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Templates from text files (whole licences, say), named as the files are without their ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\A(.*?)(\.txt)?\z", 1).alias("name"), "value")
    if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > MOST_CHARS:
        raise ValueError(f"templates of more than {MOST_CHARS} characters")
    return sorted((r.name, r.value) for r in files.collect())


def postings(templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> tuple[list[tuple], list[tuple]]:
    """Rows (tid, licence, size, least, reach) of the templates, and (gram, tid, gid) of their
    bigrams, as many as these are. ``least``: bigrams that a match shares; ``reach``: other bigrams
    that all of the template's can pay for."""
    given = TEMPLATES if templates is None else templates
    if sum(len(text) for _, text in given) > MOST_CHARS:
        raise ValueError(f"templates of more than {MOST_CHARS} characters")
    mille = round(1000 * threshold)
    kinds, grams = [], []
    for tid, (licence, own) in enumerate(sorted((name, found) for name, text in given if (found := bigrams(text)))):
        b = len(own)
        kinds.append((tid, licence, b, -(-b * mille // (2000 - mille)), (2000 - mille) * b // mille))
        grams += [(g, tid, gid) for gid, g in enumerate(own)]
    return kinds, grams


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, dice, first_word, n_words): for each document and licence its best place.

    The coefficient of a place is 2 s / (a + b) with s bigrams of the template found there (each
    counted once), a those and all others of the place, and b bigrams of the template. Each template
    has one place in a document, that of the greatest sum of all places, of equals the first to end and
    then the first to start; if any place reaches the threshold, that one does; a licence takes its best
    (then its largest template, then the earliest place). Where places of different licences overlap,
    the one of greater coefficient stays, of equals that of the larger template, then of the smaller
    name. Null and empty texts and those of one word match nothing; texts are taken whole. Rows of
    equal id and text count once; rows of equal id and other text are documents of their own. Other
    columns are left out, whatever their names. An empty table, or no template, gives no rows.
    """
    spark, mille = docs.sparkSession, round(1000 * threshold)
    kinds, grams = postings(templates, threshold)
    kind = F.broadcast(spark.createDataFrame(kinds, "tid int, licence string, size int, least int, reach int"))
    index = spark.createDataFrame(grams, "gram string, tid int, gid int")
    index = F.broadcast(index) if len(grams) <= SENT_ROWS else index
    plain = F.btrim(F.regexp_replace(ascii_lower(F.col(text_col)), _OTHER, " "), F.lit(" "))
    words = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("doc"), F.xxhash64(text_col).alias("h"), F.split(plain, " ").alias("w")).filter(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))
    found = words.select("doc", "h", F.posexplode(pairs).alias("p", "gram")).join(index, "gram")
    hits = found.groupBy("doc", "h", "tid", "gid", "p").agg(F.lit(1).alias("one"))
    one = ["doc", "h", "tid"]  # a struct, as null ids are joined too
    every = Window.partitionBy(*one)
    x = hits.withColumn("hits", F.count("*").over(every)).join(kind, "tid").filter("hits >= least")
    others = F.col("p") - F.row_number().over(every.orderBy("p"))  # other bigrams up to here
    x = saved(x.select(*one, "licence", "size", "reach", "gid", "p", others.alias("others")), "hits")
    range_ = F.floor(F.col("others") / (F.col("reach") + 1))
    starts = x.groupBy(*one, "reach", "others").agg(F.min("p").alias("start")).select(*one, "start", F.col("others").alias("before"), F.explode(F.array(range_, range_ + 1)).alias("range"))
    met = x.withColumn("range", range_).join(starts, [*one, "range"]).filter("others between before and before + reach and p >= start")
    again = F.lag("p").over(Window.partitionBy(*one, "start", "gid").orderBy("p"))
    met = met.withColumn("fresh", F.when(again.isNull(), 1).otherwise(0))
    so_far = Window.partitionBy(*one, "start").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("s", F.sum("fresh").over(so_far)).withColumn("cost", F.col("others") - F.col("before"))
    score = (2000 - mille) * F.col("s") - mille * F.col("cost")
    best = F.max(F.struct(score.alias("score"), (-F.col("p")).alias("end"), (-F.col("start")).alias("start"), "s", "cost"))
    place = met.groupBy(*one, "licence", "size").agg(best.alias("b")).select(*one, "licence", "size", "b.s", (F.col("b.s") + F.col("b.cost")).alias("a"), (-F.col("b.start")).alias("start"), (-F.col("b.end")).alias("end"))
    place = place.filter(2000 * F.col("s") >= mille * (F.col("a") + F.col("size")))
    match = F.struct((F.lit(2.0) * F.col("s") / (F.col("a") + F.col("size"))).alias("dice"), "size", "licence", "start", "end")
    better = lambda o, m: (o["dice"] > m["dice"]) | (o["dice"] == m["dice"]) & ((o["size"] > m["size"]) | (o["size"] == m["size"]) & (o["licence"] < m["licence"]))
    beaten = lambda m: F.exists("all", lambda o: (o["licence"] != m["licence"]) & (o["start"] <= m["end"]) & (m["start"] <= o["end"]) & better(o, m))
    kept = place.groupBy("doc", "h").agg(F.collect_list(match).alias("all")).select("doc", "h", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("m"))
    top = kept.groupBy("doc", "h", "m.licence").agg(F.max(F.struct("m.dice", "m.size", (-F.col("m.start")).alias("start"), "m.end")).alias("t"))
    return top.select("doc.doc_id", "licence", "t.dice", (-F.col("t.start")).cast("long").alias("first_word"), (F.col("t.end") + F.col("t.start") + 2).cast("long").alias("n_words"))
