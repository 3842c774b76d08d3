"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Of every text its header (the comment at its top), its paragraphs and its
lines are held against template notices and licence texts by the cosine of
TF-IDF vectors; of licence files the whole text is, too. Document frequencies
of the templates' terms are counted over all texts; a term that no template
has counts as a term of one text, the rarest there is. Parts that cannot reach
the threshold are left out by a bound: a part's cosine to any template is at
most the share of its length that lies on the templates' terms. What is left
meets the templates in a join on terms. A document's own licence is its best
part's. Documents without one inherit from the licence file of the nearest
directory above them, by joins of directories with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Staging

TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Lines of marks alone end a paragraph; lines that begin like this are comments.
NO_TEXT = r"""^[ \t\r#*/;%<>!"'`-]*$"""
COMMENT = r"""^[ \t]*(?:#|//|/\*|\*|;|%|--|<!--|[rRuU]?"{3}|[rRuU]?'{3})"""
LICENCE_FILE = r"(?i)^(licen[sc]e|copying)"

# Public licence names, their usual notices, and texts of the short ones.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GPL_COPY = " You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = [("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"), ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007")]
_CC = [("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives")]
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    *[(i, f"This project is licensed under the terms of the {name} license") for i, name in (("MIT", "MIT"), ("Apache-2.0", "Apache 2.0"), ("BSD-3-Clause", "BSD 3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL 2.0"))],
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) {_BSD_1} {_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) {_BSD_1} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_3),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    *[(i, f"GNU {name} Version {version}, {date}") for i, name, version, date in _GNU],
    *[(i, _GPL.format(name=name, version=version)) for i, name, version, _ in _GNU],
    *[(i, (_GPL + _GPL_COPY).format(name=name, version=version)) for i, name, version, _ in _GNU],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *[(i, f"Licensed under CC {short} 4.0") for i, short, _ in _CC],
    *[(i, f"Creative Commons {name} 4.0 International Public License") for i, _, name in _CC],
    *[(i, f"This work is licensed under a Creative Commons {name} 4.0 International License http://creativecommons.org/licenses/{short.lower()}/4.0/") for i, short, name in _CC],
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
TEMPLATES += [(i, f"SPDX-License-Identifier: {i}{tail}") for i in dict.fromkeys(i for i, _ in TEMPLATES) for tail in (("-only", "-or-later") if "GPL" in i else ("",))]
#: A choice of two licences in an SPDX line counts as the choice; terms have no order, so the names are in that of the alphabet.
TEMPLATES += [(f"{a} OR {b}", f"SPDX-License-Identifier: {a} OR {b}") for a, b in (("Apache-2.0", "BSD-3-Clause"), ("Apache-2.0", "MIT"), ("BSD-3-Clause", "MIT"), ("MIT", "Unlicense"))]

_term, _no_text, _comment = re.compile(TERM), re.compile(NO_TEXT), re.compile(COMMENT)


def terms(text: str) -> list[str]:
    return _term.findall(text.lower())


def parts_of(text: str, whole: bool) -> dict[tuple[str, ...], None]:
    """The distinct parts of a text as terms: lines, paragraphs, the header, and all of it if whole."""
    lines = text.split("\n")
    by_line = [terms(x) for x in lines]
    parts = dict.fromkeys(map(tuple, by_line))
    paragraph: list[str] = []
    for line, own in zip([*lines, ""], [*by_line, []]):
        if _no_text.match(line):
            parts[tuple(paragraph)] = None
            paragraph = []
        else:
            paragraph += own
    top = next((i for i, x in enumerate(lines) if not _comment.match(x)), len(lines))
    parts[tuple(t for own in by_line[:top] for t in own)] = None
    if whole:
        parts[tuple(t for own in by_line for t in own)] = None
    parts.pop((), None)
    return parts


def _idf(total: int, df: int) -> float:
    return math.log((1 + total) / (1 + df)) + 1


def _frequencies(vocabulary: frozenset[str]):
    """Texts -> (term, n): the task's texts that have each term of the templates, and under '' all its texts."""

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    n[""] += 1
                    n.update(vocabulary.intersection(terms(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return run


def _likely_parts(idf: dict[str, float], rare: float, least: float):
    """Rows (doc_id, key, whole, text) -> (doc_id, key, part, term, w, norm) of the parts that may reach `least`, terms of templates only."""

    def run(batches):
        for b in batches:
            rows = []
            for i, key, whole, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                for part in parts_of(text.as_py() or "", whole):
                    tf = Counter(part)
                    known = {t: n * idf[t] for t, n in tf.items() if t in idf}
                    on = sum(w * w for w in known.values())
                    off = sum((n * rare) ** 2 for t, n in tf.items() if t not in idf)
                    if on and on >= least * least * (on + off) * (1 - 1e-9):  # no template's cosine is above sqrt(on / (on + off))
                        name = xxhash.xxh3_64_intdigest(" ".join(part)) - 2**63
                        rows += [(i, key, name, t, w, math.sqrt(on + off)) for t, w in known.items()]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "key", "part", "term", "w", "norm"])

    return run


def own_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """docs(doc_id, key, whole, text) -> (doc_id, key, own_license, cosine) of the rows whose best part reaches `least`."""
    spark = docs.sparkSession
    shapes = [(i, name, t, n) for i, (name, wording) in enumerate(templates) for t, n in Counter(terms(wording)).items()]
    vocabulary = frozenset(t for _, _, t, _ in shapes)
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = dict(counted.collect())  # one row a term of the templates
    total = df.pop("", 0)
    idf = {t: _idf(total, df.get(t, 0)) for t in vocabulary}
    lengths: dict[int, float] = {}
    for i, _, t, n in shapes:
        lengths[i] = lengths.get(i, 0.0) + (n * idf[t]) ** 2
    form = spark.createDataFrame([(i, name, t, n * idf[t] / math.sqrt(lengths[i])) for i, name, t, n in shapes], "t int, license string, term string, v double")
    parts = docs.mapInArrow(_likely_parts(idf, _idf(total, 1), least), "doc_id long, key long, part long, term string, w double, norm double")
    # a part that rows share by id and text enters once
    parts = parts.groupBy("doc_id", "key", "part", "term").agg(F.first("w").alias("w"), F.first("norm").alias("norm"))
    near = parts.join(F.broadcast(form), "term").groupBy("doc_id", "key", "part", "t", "license").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.first("norm"), 6).alias("cosine"))
    best = near.where(F.col("cosine") >= least).groupBy("doc_id", "key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("doc_id", "key", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"))


def folder(path: Column) -> Column:
    """The path up to its last slash; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, down to the top ('')."""
    parts = F.split(folder(path), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6, licence_file: str = LICENCE_FILE) -> DataFrame:
    """One row per row of docs(doc_id, path, text): doc_id, path, own_license, cosine, license, inherited_from.

    license: the own one, else that of the nearest ancestor directory with a
    licence file that has one (of several, the best cosine, then the first
    name); inherited_from is that directory, null for an own licence and for
    none. Null and empty texts have no own licence; a null path inherits
    nothing. Rows that share id and text share what any of them has; ties
    between templates go to the first licence by name. Extra columns are
    ignored; an empty table gives an empty one.
    """
    st = Staging(docs.sparkSession, "licenses")
    name = F.regexp_extract(F.col("path").cast("string"), r"([^/]*)$", 1)
    whole = F.coalesce(name.rlike(licence_file), F.lit(False)).alias("whole")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), whole, F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    # staged, so that Spark knows the size of each side and can split hot keys
    own = st.put(own_licenses(docs.select("doc_id", "key", "whole", "text"), templates, least).withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "own")
    files = docs.select("doc_id", "path", "key", "whole").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").drop("_id", "_key", "key")
    files = st.put(files, "files")
    folders = files.where(F.col("own_license").isNotNull() & F.col("whole")).groupBy(folder(F.col("path")).alias("folder")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_license")).getField("own_license").alias("found"))
    # directories, not documents, meet their ancestors: a directory of many files enters once
    own_folders = files.where(F.col("path").isNotNull()).select(folder(F.col("path")).alias("at"), "path").groupBy("at").agg(F.min("path").alias("path"))
    above = own_folders.select("at", F.posexplode(ancestors(F.col("path"))).alias("up", "folder")).join(folders, "folder")
    nearest = above.groupBy("at").agg(F.min(F.struct("up", "folder", "found")).alias("n"))
    nearest = st.put(nearest.select("at", F.col("n.folder").alias("from_folder"), F.col("n.found").alias("found")), "nearest")
    out = files.withColumn("at", folder(F.col("path"))).join(nearest, "at", "left")
    lacking = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "found").alias("license"), F.when(lacking, F.col("from_folder")).alias("inherited_from"))
