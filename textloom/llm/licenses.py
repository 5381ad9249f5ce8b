"""Licence scans: TF-IDF cosine to templates, then inheritance along directories (operator 6).

Every line, every block of lines and the whole of a text are compared with the templates as
sparse TF-IDF vectors over lower-cased words. Document frequencies of the templates' words come
from all documents; a word that no template has weighs as if no document had it, each time it
occurs. A text that as a whole is a licence, or is named like one, licenses its directory;
documents without a licence of their own take that of the nearest directory above them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table, staged
from .vectext import _SPACE, Words, slabs, utf8

LEAST, FILE_LEAST = 0.75, 0.5
#: Digits of a cosine; beyond them the first template, or the greater name of files, decides.
DIGITS = 9
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_1 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_BSD_2 = """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Licence and text of a whole notice or short licence (fixed values: public texts in their usual wording). Callers may pass their own.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the terms of the MIT license."),
    ("ISC", _ISC),
    ("ISC", f"{_ISC}\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE}\n\n{_APACHE_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", f"{_GPL.format(3)}\n\n{_GPL_END}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", f"{_GPL.format(2)}\n\n{_GPL_END}"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", _LGPL.format("2.1")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", _LGPL.format(3)),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", _AGPL),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0", "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC0-1.0")),
    *((x, f"SPDX-License-Identifier: {x}-{y}") for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later")),
)
#: How the texts of long licences begin: a text whose first block is one of these is that licence's file.
TITLES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE\nVersion 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n=================================="),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)


def license_texts(folder: str) -> tuple[tuple[str, str], ...]:
    """Whole licences as templates, from a folder of the driver that has a text file for each, named by the licence.

    They go to ``templates`` beside the notices, so that a licence file is known by its whole text
    as well and not by its title alone. Names get the form of SPDX where they lack it (GPL-3: GPL-3.0);
    links and empty files are no licences of their own.
    """
    out = []
    for path in sorted(Path(folder).iterdir()):
        if path.is_file() and not path.is_symlink() and (text := path.read_text(encoding="utf-8", errors="replace")).strip():
            name = path.name.removesuffix(".txt")
            out.append((f"{name}.0" if re.fullmatch(r".*-\d", name) else name, text))
    return tuple(out)


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([None if x is None else x.lower() for x in column.to_pylist()], pa.string()))


def _words(texts: list[str]) -> list[np.ndarray]:
    data, offs = _lower(pa.array(texts, pa.string()))
    words = Words(data, offs, loose=True)
    hashes = words.hashes()
    return [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


class Templates:
    """Sparse vectors of templates, as postings of their words; weights are set once frequencies are known."""

    def __init__(self, templates: tuple[tuple[str, str], ...], titles: tuple[tuple[str, str], ...] = ()):
        both = [*templates, *titles]
        self.names, self.title = [n for n, _ in both], np.arange(len(both)) >= len(templates)
        bags = _words([t for _, t in both])
        self.vocabulary = np.unique(np.concatenate([*bags, np.zeros(0, np.uint64)]))
        term = np.searchsorted(self.vocabulary, np.concatenate([*bags, np.zeros(0, np.uint64)]))
        of = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
        pair, self.count = np.unique(term * max(1, len(bags)) + of, return_counts=True)
        self.term, self.template = pair // max(1, len(bags)), pair % max(1, len(bags))
        #: postings of a term: first[term] to first[term + 1]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))

    def weigh(self, documents: int, having: np.ndarray) -> None:
        self.idf = np.log((1 + documents) / (1 + having)) + 1
        self.other = math.log(1 + documents) + 1
        weight = self.count * self.idf[self.term]
        norm = np.sqrt(np.bincount(self.template, weight**2, minlength=len(self.names)))
        self.weight = weight / norm[self.template]


def _frequencies(templates: Templates) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, n = np.zeros(len(templates.vocabulary), np.int64), 0
        for batch in batches:
            data, offs = _lower(batch.column(0))
            for i, j in slabs(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], loose=True)
                term, row = _terms(templates, words.hashes()), words.row
                pair = np.unique(row[term >= 0] * len(having) + term[term >= 0])
                np.add.at(having, pair % max(1, len(having)), 1)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(having)), -1)), pa.array(np.append(having, n))], names=["term", "n"])

    return run


def _terms(templates: Templates, hashes: np.ndarray) -> np.ndarray:
    if not len(templates.vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(templates.vocabulary, hashes), len(templates.vocabulary) - 1)
    return np.where(templates.vocabulary[at] == hashes, at, -1)


def cosines(templates: Templates, term: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine and its first template of each unit, for the term (-1: none of a template's) and unit of each word."""
    other = np.bincount(unit[term < 0], minlength=units)[:units] * templates.other**2
    known = term >= 0
    v, n = max(1, len(templates.vocabulary)), max(1, len(templates.names))
    pair, count = np.unique(unit[known] * v + term[known], return_counts=True)
    at, t = pair // v, pair % v
    weight = count * templates.idf[t] if len(t) else np.zeros(0)
    norm = np.sqrt(other + np.bincount(at, weight**2, minlength=units)[:units])
    best, which = np.zeros(units), np.full(units, -1)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    for i in range(0, len(starts), 4096):  # units at a time, to bound their rows of sums
        a, b = starts[i], starts[i + 4096] if i + 4096 < len(starts) else len(at)
        own = at[starts[i : i + 4096]]
        size = templates.first[t[a:b] + 1] - templates.first[t[a:b]]
        posting = np.repeat(templates.first[t[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of = np.repeat(np.cumsum(np.append(0, at[a + 1 : b] != at[a : b - 1])), size)
        dots = np.bincount(of * n + templates.template[posting], np.repeat(weight[a:b], size) * templates.weight[posting], minlength=len(own) * n).reshape(len(own), n) / norm[own][:, None]
        dots = np.round(dots, DIGITS)  # what is equal but for the order of sums is equal
        which[own], best[own] = dots.argmax(axis=1), dots.max(axis=1)
    return best, which


def block_ends(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the line ends those of lines with nothing but white space (a carriage return is white space)."""
    seen = np.append(0, np.cumsum(~_SPACE[raw]))
    return ends[np.diff(seen[ends], prepend=-1) == 0] if len(ends) else ends


def scanned(templates: Templates, texts: pa.Array, least: float) -> tuple[list[str | None], list[float], list[float]]:
    """Best licence and cosine of each text over its lines, blocks and whole, and how much the text as a whole is a licence's file."""
    data, offs = _lower(texts)
    name, score, whole = [], [], []
    for i, j in slabs(offs):
        raw, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        words = Words(raw, own, loose=True)
        term, n = _terms(templates, words.hashes()), j - i
        best, which, total = np.zeros(n), np.full(n, -1), np.zeros(n)
        ends = np.flatnonzero(raw == 10)
        for kind, breaks in enumerate((ends, block_ends(raw, ends), ends[:0])):
            line = np.searchsorted(breaks, words.start)
            new = np.append(True, (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1]))[: len(line)]
            first, unit = np.flatnonzero(new), np.cumsum(new) - 1
            cos, template = cosines(templates, term, unit, len(first))
            row = words.row[first]
            order = np.lexsort((-template, cos, row))
            last = np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True)) if len(row) else np.zeros(0, np.int64)
            top = order[last]
            better = cos[top] > best[row[top]]
            best[row[top][better]], which[row[top][better]] = cos[top][better], template[top][better]
            if kind == 1:  # a first block that is a long licence's title
                begins = np.append(True, row[1:] != row[:-1])[: len(row)] & (template >= 0) & (cos >= least)
                begins[begins] = templates.title[template[begins]]
                total[row[begins]] = cos[begins]
                which[row[begins]], best[row[begins]] = template[begins], np.maximum(best[row[begins]], cos[begins])
            elif kind == 2:
                total[row] = np.maximum(total[row], cos)
        name += [templates.names[k] if k >= 0 else None for k in which]
        score += best.tolist()
        whole += total.tolist()
    return name, score, whole


def _scanned(templates: Templates, least: float) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score, whole = scanned(templates, batch.column(batch.schema.get_field_index("text")), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.float64())], names=["doc_id", "path", "name", "score", "whole"])

    return run


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, titles: tuple[tuple[str, str], ...] = TITLES, least: float = LEAST, file_least: float = FILE_LEAST, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, path, own_license and its score (null below ``least``), is_file, license, from_directory.

    A document is a licence file if its whole text has cosine ``file_least``, its first block is
    the title of a long licence, or it is named like a licence and has one. Of several files in a
    directory the one of the best score counts, then the greater name; of templates that are as
    near the first. Null paths inherit nothing; null and empty texts have no licence, texts may
    have any length; a path without a slash lies in the root, ''. Rows that repeat, or share an
    id, are scanned each; an empty table gives an empty one. Other columns are ignored.
    """
    made = Templates(templates, titles)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    counts = texts.select("text").mapInArrow(_frequencies(made), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    having = {r["term"]: r["n"] for r in counts.collect()}  # a row for each word of the templates
    made.weigh(having.get(-1, 0), np.array([having.get(k, 0) for k in range(len(made.vocabulary))]))
    kind = dict(docs.dtypes)[id_col]
    found = texts.mapInArrow(_scanned(made, least), f"doc_id {kind}, path string, name string, score double, whole double")
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    has = F.col("score") >= least
    found = found.select("doc_id", "path", F.when(has, F.col("name")).alias("own_license"), F.when(has, F.col("score")).alias("own_score"), ((has & named) | (F.col("whole") >= file_least)).alias("is_file"), "name", "score", F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "").alias("directory"))
    found = staged(found, "scanned")
    held = found.filter("is_file AND directory IS NOT NULL").groupBy("directory").agg(F.max(F.struct("score", "name")).alias("best")).select("directory", F.col("best.name").alias("license"))
    # each directory with all that are above it: the nearest with a licence
    parts = F.split("directory", "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(parts))
    above = found.select("directory").filter("directory IS NOT NULL").distinct().select("directory", F.posexplode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "above")).filter("depth = 0 OR above <> ''")
    nearest = above.join(held.withColumnRenamed("directory", "at"), F.col("above") == F.col("at")).groupBy("directory").agg(F.max(F.struct("depth", "above", "license")).alias("near"))
    nearest = staged(nearest.select("directory", F.col("near.license").alias("near"), F.col("near.above").alias("from_directory")), "nearest")  # written, so that the join can split a hot directory
    out = found.join(nearest, "directory", "left")
    own = F.col("own_license")
    return out.select("doc_id", "path", "own_license", "own_score", "is_file", F.coalesce(own, "near").alias("license"), F.when(own.isNull(), F.col("from_directory")).alias("from_directory"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies at source/doc_id, translations (not en) in source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.when(F.col("lang") != "en", F.col("lang")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences along made-up trees: a source's documents lie at four depths, and every third is named as a licence."""
    docs, number = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    depth = F.when(number % 9 == 0, 0).when(number % 3 == 0, 1).otherwise(number % 3 + 1)
    parts = F.array("source", (number % 4).cast("string"), F.lit("src"), F.lit("lib"))
    name = F.when(number % 3 == 0, "LICENSE").otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    path = F.concat(F.array_join(F.slice(parts, F.lit(1), depth.cast("int") + 1), "/"), F.lit("/"), name)
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"), file_least=2.0)
    return found.select("doc_id", "own_license", F.round("own_score", 6).alias("own_score"), "is_file", "license", "from_directory")


#: For the test tables, whose licence lines are these four; the order is the templates'.
INHERITANCE_ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 3 = 0 AS named, concat_ws('/', source, CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id % 4 AS VARCHAR) END, CASE WHEN doc_id % 3 > 0 THEN 'src' END, CASE WHEN doc_id % 3 = 2 THEN 'lib' END) AS dir FROM documents),
o AS (SELECT doc_id, named, dir, CASE WHEN list_contains(ls, 'Released under the MIT License.') THEN 'MIT' WHEN list_contains(ls, 'Licensed under the Apache License, Version 2.0.') THEN 'Apache-2.0'
  WHEN list_contains(ls, 'This work is licensed under the GNU General Public License, version 3.') THEN 'GPL-3.0' WHEN list_contains(ls, 'Licensed under CC BY-NC 4.0.') THEN 'CC-BY-NC-4.0' END AS own FROM d),
h AS (SELECT dir AS place, max(own) AS license FROM o WHERE named AND own IS NOT NULL GROUP BY dir),
n AS (SELECT doc_id, max_by(place, length(place)) AS place, max_by(license, length(place)) AS near FROM o JOIN h ON starts_with(dir || '/', place || '/') GROUP BY doc_id)
SELECT doc_id, own AS own_license, CASE WHEN own IS NOT NULL THEN 1.0::DOUBLE END AS own_score, named AND own IS NOT NULL AS is_file, coalesce(own, near) AS license, CASE WHEN own IS NULL THEN place END AS from_directory FROM o LEFT JOIN n USING (doc_id)
"""
