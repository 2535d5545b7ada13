"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

The lines, paragraphs, header and whole text of a file become sparse TF-IDF
vectors over words and are compared with templates by cosine. Weights come from
the templates; a word of no template has the highest weight, so foreign words
pull a block away from all templates. A text without any anchor word is passed
over: anchors are chosen so that a block without them cannot reach the
threshold. Files without a licence of their own inherit that of the licence
file in the nearest directory above, by equality joins of directory paths. A
licence file is known by its name or, where names say nothing, by its text: it
is a licence and nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

#: Cosine that a block needs.
THRESHOLD = 0.75
#: Cosine from which a whole short text is a licence and nothing else: two other words bring a one-line notice below it.
ALONE = 0.9
#: Tokens from which a text is not short; it needs the usual threshold, as licences are longer than their templates.
NOTICE = 50
#: Lines at the top of a file that are tried together.
HEADER_LINES = 40
#: Tokens of a window in which longer blocks are looked through; windows overlap by half.
WINDOW = 400

#: Licence identifiers with the wording of their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]
#: Words too common to be anchors, unless nothing else helps.
COMMON = frozenset("a an and any are as at be by for from in is it of on or the this that to was with without you your not no file see work use copy 0 1 2 3 4".split())
#: Base names of licence files, without an extension.
LICENCE_FILES = "(?i)^(un)?licen[sc]e|^copying|^copyright"

_TOKEN = re.compile(r"[^\W_]+")


def terms(text: str) -> Counter:
    return Counter(_TOKEN.findall(text.lower()))


class Templates:
    """Unit vectors of the templates, by word; weights; anchors for a threshold."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        bags = [terms(t) for _, t in templates]
        n, df = len(bags), Counter(w for b in bags for w in b)
        self.names = [name for name, _ in templates]
        self.strange = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        vectors = []
        for i, b in enumerate(bags):
            v = {w: (1 + math.log(k)) * self.idf[w] for w, k in b.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vectors.append({w: x / norm for w, x in v.items()})
            for w, x in vectors[-1].items():
                self.index[w].append((i, x))
        self.threshold, self.anchors = threshold, self._anchors(vectors, threshold)

    @staticmethod
    def _anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
        """Words such that the rest of every template has a norm below the threshold: a block of other words has a lower cosine."""
        out: set[str] = set()
        rest = [dict(v) for v in vectors]
        while over := [r for r in rest if math.sqrt(sum(x * x for x in r.values())) >= threshold - 1e-6]:
            gain = Counter()
            for r in over:
                for w, x in r.items():
                    gain[w] += x * x * (1e-6 if w in COMMON or len(w) < 3 else 1)
            word = max(sorted(gain), key=gain.__getitem__)
            out.add(word)
            for r in rest:
                r.pop(word, None)
        return sorted(out)

    def best(self, block: str) -> tuple[float, int]:
        """Cosine and number of the template nearest to a block, or to a window of a longer one; of equal ones the first.

        A block of any length is read whole: as one vector, and beyond WINDOW tokens in overlapping windows too.
        """
        bags, tokens = [], _TOKEN.findall(block.lower())
        bags.append(Counter(tokens))
        if len(tokens) > WINDOW:
            bags += [Counter(tokens[k : k + WINDOW]) for k in range(0, len(tokens) - WINDOW // 2, WINDOW // 2)]
        return min((self._nearest(b) for b in bags), key=lambda x: (-x[0], x[1]))

    def _nearest(self, bag: Counter) -> tuple[float, int]:
        dots, norm = Counter(), 0.0
        for w, k in bag.items():
            x = (1 + math.log(k)) * self.idf.get(w, self.strange)
            norm += x * x
            for i, y in self.index.get(w, ()):
                dots[i] += x * y
        if not dots:
            return 0.0, 0
        i = min(dots, key=lambda i: (-dots[i], i))
        return dots[i] / math.sqrt(norm), i

    def blocks(self, text: str) -> Iterator[tuple[str, str]]:
        """(kind, block): every line and paragraph with an anchor, the header, the whole text."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return
        lines = text.split("\n")
        held = [any(a in x for a in self.anchors) for x in low.split("\n")]
        yield from (("line", x) for x, h in zip(lines, held) if h)
        part: list[str] = []
        some = False
        for x, h in [*zip(lines, held), ("", False)]:
            if x.strip():
                part.append(x)
                some |= h
            else:
                if some and 1 < len(part):
                    yield "paragraph", " ".join(part)
                part, some = [], False
        if len(lines) > 1 and any(held[:HEADER_LINES]):
            yield "header", " ".join(lines[:HEADER_LINES])
        yield "text", text

    def alone(self, text: str) -> bool:
        """Whether a text is a licence and nothing else: as one vector it is near a template."""
        bag = terms(text)
        least = self.threshold if sum(bag.values()) >= NOTICE else max(ALONE, self.threshold)
        return self._nearest(bag)[0] >= least - 1e-12

    def scan(self, text: str | None) -> tuple[str | None, float, str | None]:
        """Licence, cosine and kind of the best block that reaches the threshold."""
        found = (0.0, 0, "")
        for kind, block in self.blocks(text or ""):
            score, i = self.best(block)
            if (score, -i) > (found[0], -found[1]):
                found = (score, i, kind)
        if found[0] >= self.threshold - 1e-12:
            return self.names[found[1]], found[0], found[2]
        return None, found[0], None


@cache
def _prepared(templates: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    return Templates(list(templates), threshold)


def scanned(files: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files with text_col replaced by own_license, cosine, found_in, alone (the text is that licence and nothing else)."""
    keep = [c for c in files.columns if c != text_col]
    given = tuple(templates)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _prepared(given, threshold)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            got = [own.scan(t) for t in texts]
            name, score, kind = zip(*got) if got else ((), (), ())
            alone = [n is not None and own.alone(t) for n, t in zip(name, texts)]
            cols = [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(kind, pa.string()), pa.array(alone, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], [*keep, "own_license", "cosine", "found_in", "alone"])

    return files.select(*keep, text_col).mapInArrow(run, ", ".join([*kept, "own_license string, cosine double, found_in string, alone boolean"]))


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherited(dirs: DataFrame, licence_dirs: DataFrame) -> DataFrame:
    """dirs (dir) with the licence of the nearest directory in licence_dirs (at, license, file) at or above it."""
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    )
    met = dirs.withColumn("at", F.explode(F.array_distinct(above))).join(licence_dirs, "at")
    return met.groupBy("dir").agg(F.max_by(F.struct("license", "file"), F.length("at")).alias("x")).select("dir", "x.license", "x.file")


@common.tracked
def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """Licence of every file: its own, else that of the licence file in the nearest directory above.

    Returns id_col, path_col, own_license, cosine (to the nearest template, 0 if
    the text has no anchor word), found_in (line, paragraph, header, text), license,
    inherited_from (path of the licence file, null unless inherited). Licence files
    have a licence and a name like LICENSE, COPYING or COPYRIGHT; with by_text, files
    of any name whose text is a licence and nothing else are licence files too. Of
    several in a directory, those known by name come before those known by text,
    then the one with the highest cosine (to nine places) counts, then the first path. Null texts have no licence of their own; files with a null path
    inherit nothing. Repeated rows are judged alike; an empty table gives an
    empty result; other columns are not read.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    found = common.written(scanned(rows, "text", templates, threshold).withColumn("dir", _directory(F.col("path"))), "licenses")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILES)
    is_file = F.col("path").isNotNull() & F.col("own_license").isNotNull() & (named | F.lit(by_text) & F.col("alone"))
    best = F.min(F.struct((~named).alias("by_text"), (-F.round("cosine", 9)).alias("c"), F.col("path"), F.col("own_license"))).alias("x")
    licence_dirs = common.written(found.where(is_file).groupBy(F.col("dir").alias("at")).agg(best).select("at", F.col("x.own_license").alias("license"), F.col("x.path").alias("file")), "licence_dirs")
    needing = found.where("own_license is null and dir is not null").select("dir").distinct()
    given = common.written(inherited(needing, licence_dirs), "inherited").withColumnRenamed("license", "inherited")
    out = found.join(given, "dir", "left").withColumn("takes", F.col("own_license").isNull())
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "cosine", "found_in", F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("takes"), F.col("file")).alias("inherited_from"),
    )


@common.tracked
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited.

    Documents have no paths of their own: source and language are their
    directories, those without a language lie in their source's. Documents that
    are a licence and nothing else are the licence files there.
    """
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"), by_text=True)
