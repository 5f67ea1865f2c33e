"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Every text is cut into passages, windows of 1 and of 4 consecutive lines; those with a
licence word (``ANCHOR``) are compared with the notices below, as sparse TF-IDF vectors over
lower-case ``[a-z0-9]+`` terms. A term weighs ``tf * (ln((1 + N) / (1 + df)) + 1)``, df being the number of
all texts that have it. A text's own licence is the template with the highest
cosine, if that is ``MIN_COSINE`` or more (ties: first template by name).

A text is its directory's licence file if its name says so or if the passage
makes up ``FILE_SHARE`` of it. Texts without own licence inherit that of the nearest
ancestor directory with a licence file (the highest cosine there, then the first path):
directories are listed once, under each of their ancestors, and joined on the path.

All of it is DataFrame expressions. Null texts have no licence of their own, but inherit;
null paths neither give nor inherit. Null ids and repeated rows are treated one by one; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.llm.common import bounded, let, text_or_empty, written

_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should "
             "have received a copy of the GNU {1} along with this {0}; if not, see <https://www.gnu.org/licenses/>.")
_GRANT = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
          "the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
          "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
          "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
          "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
          "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
          "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
          "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_ENDORSE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission. ")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. ")
_MIT_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
              "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
              "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
              "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
              "IN THE SOFTWARE.")
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
              "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
              "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
              "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
              "USE OR PERFORMANCE OF THIS SOFTWARE.")
_ISC = f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies. "
_GNU = (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3"))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: standard headers, the short licences' whole texts, and the heads of the long ones' files (without apostrophes: the SQL quotes them)
FURTHER = (
    *((name, _GRANT.format(work, title, version)) for name, work, title, version in _GNU),
    *((name, f"{_GRANT.format(work, title, version)} {_WARRANTY.format(work, title)}") for name, work, title, version in _GNU),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", _MIT), ("MIT", _MIT + _MIT_AS_IS),
    ("ISC", _ISC), ("ISC", _ISC + _ISC_AS_IS), ("0BSD", f"BSD Zero Clause License. {_USE}."), ("0BSD", f"{_USE}. {_ISC_AS_IS} Zero-Clause BSD License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD + _AS_IS), ("BSD-3-Clause", _BSD + _ENDORSE + _AS_IS),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License.") for kind, title in _CC.items()
      if kind not in ("BY", "BY-NC")),
    *((f"CC-{kind}-3.0", f"Licensed under CC {kind} 3.0.") for kind in _CC),
    *((f"CC-{kind}-3.0", f"This work is licensed under a Creative Commons {title} 3.0 Unported License.") for kind, title in _CC.items()),
)
# Notices as projects publish them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
     "except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
) + FURTHER
ANCHOR = "licen[sc]|redistribut|permission is hereby granted|public domain|copyright"
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
PASSAGE_LINES = (1, 4)
MIN_COSINE = 0.7
FILE_SHARE = 0.3
#: terms and directories that are broadcast; more are joined by shuffle
BROADCAST_ROWS = 200_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def passages(text: Column) -> Column:
    """Array of the windows of lines that have a licence word."""
    def of(lines: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, n), "\n"))

    def windows(lines: Column) -> Column:
        every = F.concat(*(of(lines, n) for n in PASSAGE_LINES))
        return F.array_distinct(F.filter(every, lambda p: F.lower(p).rlike(ANCHOR)))

    return F.when(F.lower(text).rlike(ANCHOR), let(F.split(text, "\n"), windows))


def own_licenses(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, license, cosine, passage) of the rows that match a template; ``found`` has their
    passages (row, unit, passage), ``texts`` all texts (text)."""
    spark = found.sparkSession
    templates = spark.createDataFrame(
        [(n, name, text) for n, (name, text) in enumerate(TEMPLATES)], "template int, license string, notice string")
    in_units = found.select("row", "unit", F.explode(terms(F.col("passage"))).alias("term")).groupBy(
        "row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    in_templates = templates.select("template", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy(
        "template", "license", "term").agg(F.count(F.lit(1)).alias("tf_t"))
    vocabulary = in_units.select("term").unionAll(in_templates.select("term")).distinct()
    vocabulary = written(vocabulary, "license-terms")

    total = F.lit(float(texts.count()))
    words = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if vocabulary.count() <= BROADCAST_ROWS:        # else all words are counted, and joined as counts
        words = words.join(F.broadcast(vocabulary), "term", "left_semi")
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = written(vocabulary.join(df, "term", "left").select(
        "term", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1).alias("idf")),
        "license-idf")
    u = in_units.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    t = in_templates.join(idf, "term").withColumn("weight_t", F.col("tf_t") * F.col("idf"))
    # the templates are a constant of this module: always small
    t = t.select("template", "license", "term", "weight_t")
    norms = t.groupBy("template").agg(F.sqrt(F.sum(F.col("weight_t") * F.col("weight_t"))).alias("norm_t"))
    t = F.broadcast(t.join(F.broadcast(norms), "template"))
    norm_u = u.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = u.join(t, "term").groupBy("row", "unit", "template", "license", "norm_t").agg(
        F.sum(F.col("weight") * F.col("weight_t")).alias("dot"))
    scored = dots.join(norm_u, ["row", "unit"]).select(
        "row", "unit", "license", F.round(F.col("dot") / (F.col("norm") * F.col("norm_t")), 6).alias("cosine"))
    best = scored.where(F.col("cosine") >= MIN_COSINE).groupBy("row").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "license", "unit")).alias("best"))
    best = best.select("row", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"),
                       F.col("best.unit").alias("unit"))
    return best.join(found, ["row", "unit"]).select("row", "license", "cosine", "passage")


def ancestors(directory: Column) -> Column:
    """Array of (depth, path) of a directory and all above it; the root is the empty path."""
    return let(F.split(directory, "/"), lambda parts: F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above"))))


def scan(files: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """One row per row of ``files``: id, path, license, cosine, origin (``own``, ``inherited`` or
    null), license_path (of the licence file inherited from)."""
    texts = files.select(F.col(id_col).alias("id"), F.col(path).cast("string").alias("path"), text_or_empty(text).alias("text"))
    numbered = written(texts.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"),
        F.char_length("text").alias("chars"), passages(F.col("text")).alias("passages")), "license-files")
    units = numbered.select("row", F.posexplode("passages").alias("unit", "passage"))
    own = written(own_licenses(units, texts.select("text")), "license-own")
    files_ = numbered.drop("passages").join(own, "row", "left")

    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAME)
    mostly = F.char_length("passage") >= FILE_SHARE * F.col("chars")
    givers = files_.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (named | mostly)).groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license")).alias("given"))
    givers = bounded(written(givers, "license-givers"), BROADCAST_ROWS).withColumnRenamed("directory", "above")
    heirs = files_.where(F.col("directory").isNotNull()).select("directory").distinct().select(
        "directory", F.inline(ancestors(F.col("directory"))))
    nearest = heirs.join(givers, "above").groupBy("directory").agg(
        F.max(F.struct("depth", F.col("given.license").alias("license"), F.col("given.path").alias("path"))).alias("from_"))
    nearest = bounded(written(nearest, "license-nearest"), BROADCAST_ROWS)
    joined = files_.join(nearest, "directory", "left")
    is_own = F.col("license").isNotNull()
    return joined.select(
        "id", "path", F.coalesce("license", "from_.license").alias("license"), "cosine",
        F.when(is_own, F.lit("own")).when(F.col("from_").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~is_own, F.col("from_.path")).alias("license_path"))
