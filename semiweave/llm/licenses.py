"""License scan with SQL functions alone: MinHash bands over text windows, then exact containment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Words of a shingle; a shorter template is one shingle of all its words.
SHINGLE = 5
#: Templates of more shingles, and tables of more rows, are joined by shuffle, not broadcast.
BROADCAST_SHINGLES = 200_000

# Wordings of license notices, as their stewards publish them.
TEMPLATES = [
    ("apache-2.0", "short", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("mit", "short", "Released under the MIT License."),
    (
        "mit",
        "full",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("gpl-3.0", "short", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-or-later",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "bsd-2-clause",
        "conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "isc",
        "grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "first", "This is free and unencumbered software released into the public domain."),
    ("bsd", "short", "Released under the BSD License."),
    (
        "bsd-3-clause",
        "conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "bsd",
        "disclaimer",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "gpl-2.0-or-later",
        "header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("gpl-2.0", "short", "This work is licensed under the GNU General Public License, version 2."),
    (
        "lgpl-2.1-or-later",
        "header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details.",
    ),
    (
        "lgpl-3.0-or-later",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    (
        "agpl-3.0-or-later",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details.",
    ),
    (
        "bsl-1.0",
        "grant",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "zlib",
        "grant",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    ("epl-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc-by-sa-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-3.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc-by-nc-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-nd-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-sa-4.0", "short", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "short", "Licensed under CC BY 4.0."),
    (
        "cc0-1.0",
        "notice",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    ("wtfpl", "grant", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("unlicense", "grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    (
        "gpl-3.0",
        "preamble",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. "
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    ("all-rights-reserved", "short", "All rights reserved."),
]


def _words(text: str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), "")


def _shingles(width: int) -> Column:
    """Hashes of the runs of width words of the column words, in order; none of fewer words."""
    return F.expr(f"if(size(words) < {width}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {width}), i -> xxhash64({width}, slice(words, cast(i as int) + 1, {width}))))")


#: Numbers of the windows that hold the shingle at position at. Windows of a level are 2 * 2^level shingles
#: long and start every 2^level / 2 (at least 1); a run of 1.25 * 2^level shingles lies whole in one of them.
_WINDOWS = (
    "sequence(greatest(0L, (at - 2 * shiftleft(1L, level)) div greatest(1L, shiftleft(1L, level) div 2) + if(at >= 2 * shiftleft(1L, level), 1, 0)),"
    " at div greatest(1L, shiftleft(1L, level) div 2))"
)


def bands_for(containment: float, probability: float) -> int:
    """Bands of one row that retrieve a template at the least similarity with so high a probability.

    A window of w shingles whose template has over w / 4, containment of them
    in the window, has a similarity of containment / (4 + (1 - containment)) at least.
    """
    least = containment / 4 / (1 + (1 - containment) / 4)
    return math.ceil(math.log(1 - probability) / math.log(1 - least))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, variant, text) of a folder of full texts, a file for each license named by its id."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+?)(\.txt)?$", 1).alias("license_id"), F.lit("full").alias("variant"), F.col("value").alias("text"))


def template_table(spark: SparkSession, templates: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """(template, license_id, variant, width, n, level, hs): a row for each template, hs its distinct shingles.

    Shingles have width words, SHINGLE or as many as a shorter template has;
    templates without a word are left out.
    """
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates), "license_id string, variant string, text string")
    words = templates.where("text is not null").select("license_id", "variant", _words("text").alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(SHINGLE))
    whens = fold(lambda w, k: w.when(width == k, _shingles(k)), range(1, SHINGLE), F.when(width == SHINGLE, _shingles(SHINGLE)))
    rows = words.select(F.xxhash64("license_id", "variant", "words").alias("template"), "license_id", "variant", width.alias("width"), F.array_distinct(whens).alias("hs")).distinct()
    return written(rows.withColumn("n", F.size("hs")).withColumn("level", F.ceil(F.log2("n")).cast("int")), "license-templates")


def _retrieved(hits: DataFrame, anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, row, template) where the MinHash of a window is that of a template in a band.

    A window and a template agree in a band only if the window holds the
    template's shingle of the least hash, its anchor, so windows around hits
    of anchors are all that can; there the least hash of the whole window is
    taken and compared. A text's windows are cut out once, each level's by
    themselves, and a hit meets its windows, not the text.
    """
    met = hits.join(anchors, ["width", "h"]).select("doc_id", "row", "width", "level", "band", "low", "template", F.explode(F.expr(_WINDOWS)).alias("w"))
    wanted = met.groupBy("doc_id", "row", "width").agg(F.collect_set(F.struct("level", "w")).alias("wanted"))
    window = "slice(hs, cast(c.w * greatest(1L, shiftleft(1L, c.level) div 2) as int) + 1, cast(2 * shiftleft(1L, c.level) as int))"
    cut = wanted.join(texts, ["doc_id", "row", "width"]).select("doc_id", "row", "width", F.explode(F.expr(f"transform(wanted, c -> struct(c.level, c.w, {window} as part))")).alias("c"))
    cut = cut.select("doc_id", "row", "width", "c.level", "c.w", "c.part")
    same = F.expr("array_min(transform(part, x -> xxhash64(band, x))) = low")
    return met.join(cut, ["doc_id", "row", "width", "level", "w"]).where(same).select("doc_id", "row", "template").distinct()


def scan_licenses(docs: DataFrame, templates: DataFrame | Sequence[tuple[str, str, str]] = TEMPLATES, *, containment: float = 0.8, probability: float = 0.9999) -> DataFrame:
    """(doc_id, license_id, variant, n_shingles, containment) of templates in (doc_id, text).

    Words are runs of letters and digits in lower case. A text's shingles of
    five words fall into overlapping windows of each length that templates
    need, over the whole text. The MinHash of a window, over
    bands_for(containment, probability) hash functions of a band each,
    retrieves the templates that agree in a band (see _retrieved); of these
    alone the distinct shingles that the text holds are counted, and one is
    reported if they are at least containment of its own.

    templates are rows (license_id, variant, text), also as a DataFrame (see
    read_templates). One of fewer than five words is a single shingle of all
    its words; one without words is left out. A text is taken whole. Null and empty texts match nothing; a null doc_id
    is reported as null; rows with the same doc_id and text are reported once;
    other columns are ignored; without templates the result is empty.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    bands = bands_for(containment, probability)
    least = [F.expr(f"array_min(transform(hs, x -> struct(xxhash64({k}, x) as low, x as h)))") for k in range(bands)]
    anchors = table.select("template", "width", "level", F.posexplode(F.array(*least)).alias("band", "a")).select("template", "width", "level", "band", "a.low", "a.h")
    anchors = written(anchors, "license-anchors")
    widths, rows = [r.width for r in table.select("width").distinct().orderBy("width").collect()], table.agg(F.sum("n")).first()[0] or 0
    if not widths:
        return spark.createDataFrame([], "doc_id long, license_id string, variant string, n_shingles int, containment double")
    near = F.broadcast if max(rows, anchors.count()) <= BROADCAST_SHINGLES else lambda df: df
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    worded = plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _words("text").alias("words"))
    placed = lambda k: F.transform(_shingles(k), lambda h, at: F.struct(F.lit(k).alias("width"), at.cast("long").alias("at"), h.alias("h")))
    shingles = F.flatten(F.array(*map(placed, widths)))
    each = worded.select("doc_id", "row", F.explode(shingles).alias("s")).select("doc_id", "row", "s.width", "s.at", "s.h")
    known = anchors.select(F.col("width").alias("own_width"), F.col("h").alias("known")).distinct()
    hits = written(each.join(near(known), (F.col("h") == F.col("known")) & (F.col("width") == F.col("own_width")), "left_semi").distinct(), "license-hits")

    # the texts that have any, and their shingles in order
    some = hits.select(F.col("row").alias("some_row")).distinct()
    some = F.broadcast(some) if hits.count() <= BROADCAST_SHINGLES else some
    held = worded.join(some, F.col("row") == F.col("some_row"), "left_semi").dropDuplicates(["doc_id", "row"])
    texts = held.select("doc_id", "row", F.explode(F.array(*[F.struct(F.lit(k).alias("width"), _shingles(k).alias("hs")) for k in widths])).alias("s")).select("doc_id", "row", "s.width", "s.hs")
    texts = written(texts, "license-texts")
    # a null doc_id joins as a number that no row of another text has beside the same row
    key = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    found = _retrieved(key(hits), near(anchors), key(texts)).join(near(table.select("template", "license_id", "variant", "width", "n", F.col("hs").alias("own"))), "template")
    ids = texts.select(F.col("doc_id").alias("true_id"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), "row", "width", F.array_distinct("hs").alias("hs"))
    share = F.size(F.array_intersect("hs", "own")) / F.col("n")
    found = found.join(ids, ["doc_id", "row", "width"]).withColumn("containment", share).where(F.col("containment") >= containment - 1e-12)
    return found.select(F.col("true_id").alias("doc_id"), "license_id", "variant", F.col("n").alias("n_shingles"), "containment")
