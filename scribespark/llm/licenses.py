"""Operator 5: licences by sparse TF-IDF cosine to templates, inherited from the nearest directory.

A document's units are its lines that hold a licence word and, if there are any, its whole text, its
leading comment, its paragraphs with such a word and the runs of such paragraphs; comment signs are taken
off. Units and templates (notices, file headers and whole licences) are vectors over words, weighed by idf
counted over all documents. A document whose whole text is
near a template is a licence file and licenses its directory; one with a near line has its own
licence; others take that of the nearest directory above them that has one, found by joining the
distinct directories' ancestors with the licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribespark.functions.let import let
from scribespark.llm.shared import text_of, written

# Short notices of public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright and related rights are waived, CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "This file is licensed under the terms of the GNU {0}General Public License version {1}.",
    "This program is free software under the GNU {0}General Public License version {1}.",
)
_CC = ("This work is licensed under the Creative Commons {1} 4.0 International License.", "Licensed under {0} 4.0. See https://creativecommons.org/licenses/{2}/4.0/.")
#: Wordings of file headers.
HEADERS = {
    "AGPL-3.0": [x.format("Affero ", 3) for x in _GNU],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": [x.format("CC BY", "Attribution", "by") for x in _CC],
    "CC-BY-NC-4.0": [x.format("CC BY-NC", "Attribution-NonCommercial", "by-nc") for x in _CC],
    "CC-BY-SA-4.0": [x.format("CC BY-SA", "Attribution-ShareAlike", "by-sa") for x in _CC],
    "GPL-2.0": [x.format("", 2) for x in _GNU],
    "GPL-3.0": [x.format("", 3) for x in _GNU],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-3.0": [x.format("Lesser ", 3) for x in _GNU],
    "MIT": ["Licensed under the MIT License.", "Use of this source code is governed by the MIT license that can be found in the LICENSE file.", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
#: SPDX identifiers that files name a licence by.
SPDX = {name: [f"SPDX-License-Identifier: {x}" for x in ([name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name])] for name in TEMPLATES if name != "Proprietary"}
#: Whole licences, a file each.
WHOLE = {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))}
WORDINGS = [(name, x) for name in TEMPLATES for x in [TEMPLATES[name], *HEADERS.get(name, []), *SPDX.get(name, []), *WHOLE.get(name, [])]]
#: A licence that counts only where no other is near: many licences are headed by it.
RESERVED = "Proprietary"
#: A unit needs one of these words.
LICENCE_WORDS = r"(?i)\b(?:licen[sc](?:ed?|es|ing)|copyright|redistributions?|redistribute|permission|public domain|all rights reserved|cc[ -]by|cc0)\b"
COMMENT = r"^\s*(?:#+|//+[!/]?|/\*+!?|\*+(?!/)|\*+/|--+|;+|%+|<!--)\s*|\s*(?:\*+/|-->)?\s*$"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a licence.
NEAR = 0.6


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


VOCABULARY = sorted({w for _, t in WORDINGS for w in _words(t)})


def _found_words(text: Column) -> Column:
    """The matches of WORD; cutting at anything else is cheaper than matching them."""
    return F.filter(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^a-z0-9]{2,}|[^a-z0-9.-]"), lambda w: w != "")


def _passages(text: Column) -> Column:
    """The units of a text besides itself; each line lies in four at most."""
    holds = lambda x: x.rlike(LICENCE_WORDS)
    raw = F.split(text, "\r?\n", -1)

    def of_lines(x: Column) -> Column:
        paragraphs = F.split(F.array_join(x["lines"], "\n"), "\n{2,}")
        runs = F.split(F.array_join(F.transform(paragraphs, lambda p: F.when(holds(p), p).otherwise("\u0001")), "\n"), "\u0001")
        code = F.array_position(F.transform(F.arrays_zip(x["raw"].alias("r"), x["lines"].alias("l")), lambda z: (z["r"].rlike(r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)") | (z["l"] == "")).cast("int")), 0)
        head = F.array_join(F.slice(x["lines"], F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(x["lines"])).cast("int")), "\n")
        return F.concat(F.array(head), runs, paragraphs, x["lines"])

    lines = F.transform(raw, lambda x: F.regexp_replace(x, COMMENT, ""))
    return F.filter(let(F.struct(raw.alias("raw"), lines.alias("lines")), of_lines), holds)


def scanned(docs: DataFrame, path: Column, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, path, units: one pass over each text."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("text"))
    units = F.when(text.rlike(LICENCE_WORDS), F.array_distinct(F.concat(F.array(text), _passages(text)))).otherwise(F.array().cast("array<string>"))
    return rows.select("row", "doc_id", "path", units.alias("units"))


def frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: how many documents hold it, of all documents."""
    return docs.select(F.explode(F.array_distinct(_found_words(text_of(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def cosines(table: DataFrame, counts: DataFrame) -> DataFrame:
    """row, unit (0: the whole text), license, cosine of each unit with each wording it shares words with."""
    spark = table.sparkSession
    total = table.count()
    vocabulary = F.broadcast(spark.createDataFrame([(w,) for w in VOCABULARY], "word string"))
    df = {r.word: r.n for r in counts.join(vocabulary, "word", "left_semi").collect()}
    rows = []
    for i, (name, text) in enumerate(WORDINGS):
        v = {w: n * (math.log((1 + total) / (1 + df.get(w, 0))) + 1) for w, n in Counter(_words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(w, i, name, x / norm) for w, x in v.items()]
    templates = F.broadcast(spark.createDataFrame(rows, "word string, wording int, license string, weight double"))
    units = table.where(F.size("units") > 0).select("row", F.posexplode("units").alias("unit", "text"))
    words = units.select("row", "unit", F.explode(_found_words(F.col("text"))).alias("word")).groupBy("row", "unit", "word").agg(F.count("*").alias("tf"))
    words = written(words, "unit_words")
    # a word of a unit is a word of a document: each has a count
    held = written(counts.join(words.select("word").distinct(), "word", "left_semi"), "counted")
    words = words.join(held, "word").withColumn("x", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("n"))) + 1))
    words = written(words.select("row", "unit", "word", "x"), "vectors")
    norms = words.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = words.join(templates, "word").groupBy("row", "unit", "wording", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    return dots.join(norms, ["row", "unit"]).select("row", "unit", "license", F.least(F.lit(1.0), F.round(F.col("dot") / F.col("norm"), 9)).alias("cosine"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR) -> DataFrame:
    """A row for each document: doc_id, path, license, score, origin, origin_path.

    ``origin``: "own" (a near line or text of its own), "inherited" (from the licence file in the nearest
    directory above, whose path is ``origin_path``) or null. Of equal cosines the first licence by name
    counts, reserved rights only without any other licence, in a directory the nearest licence file, then the first path. Null texts are empty, null paths
    lie in the root; repeated rows are scanned each; extra columns are left out; an empty table gives no rows.
    """
    table = written(scanned(docs, path, id_col, text_col), "scanned")
    near_units = cosines(table, written(frequencies(docs, text_col), "frequencies")).where(F.col("cosine") >= near)
    order = F.struct((F.col("license") == RESERVED).alias("reserved"), (-F.col("cosine")).alias("x"), "license")
    best = near_units.groupBy("row").agg(F.min(order).alias("own"), F.min(F.when(F.col("unit") == 0, order)).alias("file"))
    rows = table.select("row", "doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).join(best, "row", "left")
    rows = written(rows, "licensed")
    files = rows.where("file is not null").groupBy("dir").agg(F.min(F.struct("file", "path")).alias("f"))
    files = files.select(F.col("dir").alias("above"), F.col("f.file.license").alias("license"), (-F.col("f.file.x")).alias("score"), F.col("f.path").alias("from"))
    # the directories that need one, and what is above each: itself, its parents, the root
    dirs = rows.where("own is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = above.join(files, "above").groupBy("dir").agg(F.max_by(F.struct("license", "score", "from"), "depth").alias("up"))
    out = rows.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.when(own, F.col("own.license")).otherwise(F.col("up.license")).alias("license"),
        F.when(own, -F.col("own.x")).otherwise(F.col("up.score")).alias("score"),
        F.when(own, "own").when(F.col("up").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("up.from")).alias("origin_path"),
    )
