"""License scans: MinHash bands over overlapping text windows, then exact containment.

Native: DataFrame functions only.  A template of m words is looked for in
windows that start every m / 4 words and are long enough to hold it whole.  A
window and a template that agree in a band of MinHash values are candidates;
the share of the template's shingles that the window holds decides.

With n of a template's shingles in common, a window of at most 5/4 its words
has a Jaccard similarity of about 0.8 n / (n + n/4 + n/5), over 0.5 (for the
shortest, one shingle of two, 0.5).  A band of one MinHash value agrees with
that probability, and one of 16 bands with 1 - 0.5**16, over 0.9999.  Only
windows with a template shingle are looked at; the others hold nothing of any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm.common import bind, read

SHINGLE, BANDS, ROWS = 5, 16, 1
#: Templates are broadcast and their shingles are literals of the plan; more than this many of either are refused.
MAX_TEMPLATES, MAX_SHINGLES = 5000, 200_000

_BSD_LIABILITY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Short notices, opening sentences, and whole texts of the short licenses (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
     "IN THE SOFTWARE."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0",
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "modify it under the terms of the GNU General Public License"),
    ("LGPL", "modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL", "modify it under the terms of the GNU Affero General Public License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", _BSD_LIABILITY),
    ("BSD-3-Clause",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission."),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
     "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
     "and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
     "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense",
     "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
)

_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # ASCII but for letters and digits, after lower-casing


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), "")


def shingles_of(words: Column, start: Column, stop: Column, size: int | Column) -> Column:
    """Hashes of the ``size``-word runs that begin at places ``start`` to ``stop`` (from 1); none if stop < start."""
    runs = F.transform(F.sequence(start, F.greatest(start, stop)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(stop >= start, runs).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column, bands: int, rows: int) -> Column:
    """(band, hash) of each band of ``rows`` MinHash values."""
    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(F.lit(k), x)))
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * rows + r) for r in range(rows)]).alias("value")) for b in range(bands)])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(template, license, size, n, shingles)``; a template of under five words is one shingle."""
    rows = [(i, str(a), b) for i, (a, b) in enumerate(templates)]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    t = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", words_of(F.col("text")).alias("words"))
    t = t.withColumn("size", F.size("words")).where("size > 0").withColumn("n", F.least(F.lit(SHINGLE), "size"))
    return t.select("template", "license", "size", "n",
                    F.array_distinct(shingles_of(F.col("words"), F.lit(1), F.col("size") - F.col("n") + 1, F.col("n"))).alias("shingles"))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, license, containment, word_start)`` of every license that a document's text holds.

    ``containment``: share of the template's five-word shingles in one window,
    the best of all its templates and windows; ``word_start``: the first word
    (from 0) of the earliest such window that belongs to the template.  Null
    and empty texts hold nothing; rows that share an id, null too, are one
    document's parts; a text of any length is looked at whole; an empty table
    gives an empty result; other columns are not read.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment must be in (0, 1]")
    spark = docs.sparkSession
    table = template_table(spark, templates).collect()  # at most MAX_TEMPLATES rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    if sum(len(t["shingles"]) for t in table) > MAX_SHINGLES:
        raise ValueError(f"templates of more than {MAX_SHINGLES} shingles")
    kinds = sorted({(t["n"], t["size"]) for t in table})
    if not kinds:
        return texts.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("word_start"))
    found = None
    for n in sorted({n for n, _ in kinds}):
        known = {size: sorted({s for t in table if t["size"] == size for s in t["shingles"]}) for k, size in kinds if k == n}
        # explode_outer: its input is evaluated once, with no filter derived from it
        windows = (texts.where(F.size("words") >= n)
                   .select("words", "doc_id", F.explode_outer(_windows(F.col("words"), n, known)).alias("w")).where("w IS NOT NULL")
                   .select("doc_id", "w.size", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.span")).alias("inside")))
        banded = (windows.select("*", F.explode_outer(bind(_held(n), lambda h: signature(h, bands, rows))).alias("k"))
                  .select("doc_id", "size", "start", "inside", "k.band", "k.value"))
        own = F.broadcast(template_table(spark, templates).where(F.col("n") == n)
                          .select("license", "size", "shingles", F.explode_outer(signature(F.col("shingles"), bands, rows)).alias("k"))
                          .select("license", "size", "shingles", "k.band", "k.value"))
        share = F.size(F.array_intersect(_held(n), "shingles")) / F.size("shingles")
        # first word of the window that belongs to the template
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.size("inside") - (n - 1)), lambda i: F.array_contains("shingles", F.xxhash64(F.slice("inside", i, n)))))
        got = (banded.join(own, ["size", "band", "value"]).select("doc_id", "license", share.alias("containment"), "start", "inside", "shingles")
               .where(F.col("containment") >= containment)
               .select("doc_id", "license", "containment", (F.col("start") + at - 1).cast("long").alias("word_start")))
        found = got if found is None else found.union(got)
    best = F.max(F.struct("containment", (-F.col("word_start")).alias("early")))
    return found.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", "best.containment", (-F.col("best.early")).alias("word_start"))


def _held(n: int) -> Column:
    return F.array_distinct(shingles_of(F.col("inside"), F.lit(1), F.size("inside") - (n - 1), n))


def _windows(words: Column, n: int, known: dict[int, list[int]]) -> Column:
    """(size, start, span) of each window of ``words`` that holds a shingle of a template of its size.

    ``known``: the shingles of all templates of a size; windows of ``size`` start every size / 4 words.
    """
    def of(some):
        return lambda i: F.xxhash64(F.slice(words, i, n)).isin(sorted(some))

    places = F.filter(F.sequence(F.lit(1), F.size(words) - (n - 1)), of(set().union(*known.values())))

    def of_size(hits: Column, size: int) -> Column:
        step = max(1, size // 4)
        span = size + step  # holds any run of ``size`` words whole, wherever it starts
        starts = F.array_distinct(F.flatten(F.transform(F.filter(hits, of(known[size])), lambda p: F.sequence(
            F.greatest(F.lit(0), F.ceil((p - 1 + n - span) / step).cast("int")), F.floor((p - 1) / step).cast("int")))))
        return F.transform(starts, lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start"), F.lit(span).alias("span")))

    def around(hits: Column) -> Column:
        return F.flatten(F.array(*[of_size(hits, size) for size in known]))

    return bind(places, lambda hits: F.when(F.size(hits) > 0, around(hits)))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
