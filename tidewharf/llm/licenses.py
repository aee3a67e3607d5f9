"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are license texts and their parts, titles, the usual notices made from each license's
names, and SPDX tags. A section is a sentence, a line, a paragraph (lines up to an empty one) or
the whole text, of any length. Its sparse TF-IDF vector is compared with each template's. A section
speaks for the license of the nearest template if the cosine reaches ``MIN_COSINE`` and the next
license is at least ``MARGIN`` further off: "GNU General Public License" without a version is as near
to one version as to the other and says neither, and so is a paragraph that licenses share. The best
section that speaks gives a file its own license. A word's weight follows the share of all lines
of the corpus that hold it; words in no template weigh as much as a word in one line. A file of at most
``FILE_WORDS`` words, or named like one, that has a license is a licence file: its license holds for
its directory, and for each file below without a license of its own from the nearest directory
above that has one.

Inheritance is worked out for distinct directories: a directory's ancestors (as many as
it has levels) are joined to the licensed directories, the deepest one wins, and files
are joined to their directory last.

Defined results: null and empty texts have no license of their own and may inherit; a null
path is in no directory and inherits nothing; of sections with equal cosines, and of licence files
of a directory, the first license by name is taken; rows may repeat and keep their number; columns
of the caller stay, whatever their names, but for the four results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewharf.llm.common import lean, saved

MIN_COSINE = 0.75
MARGIN = 0.01
FILE_WORDS = 60

# SPDX identifiers with the names that notices use.
LICENSES = (
    ("AGPL-3.0", ("GNU Affero General Public License version 3", "AGPLv3", "AGPL-3.0")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License", "BSD 3-Clause \"New\" or \"Revised\" License")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPLv2", "GPL-2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPLv3", "GPL-3.0")),
    ("ISC", ("ISC License",)),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0")),
    ("MIT", ("MIT License", "MIT License (MIT)", "Expat License")),
    ("MPL-2.0", ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0",
                 "Mozilla Public License Version 2.0")),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("zlib License",)),
)
_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_COMMONS_VERSIONS = (("4.0", "International"), ("3.0", "Unported"))
_FRAMES = (
    "{}", "The {}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.",
    "Distributed under the {}.", "This project is licensed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.",
)
_FIELD = "License: {}"
_TAG = "SPDX-License-Identifier: {}"

_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your "
    "option) any later version.")
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:")
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_START = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions:")
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
    "in all copies.")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")

# License texts, their parts that tell them apart, titles and notices.
TEXTS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GPL_NOTICE.format("Affero General Public License", "3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
                   "to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
                   "License for the specific language governing permissions and limitations under the "
                   "License."),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and "
                   "distribution as defined by Sections 1 through 9 of this document."),
    ("BSD-2-Clause", _BSD_START),
    ("BSD-2-Clause", _BSD_TWO),
    ("BSD-2-Clause", _BSD_END),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_START),
    ("BSD-3-Clause", _BSD_TWO),
    ("BSD-3-Clause", _BSD_END),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and "
                "change it. By contrast, the GNU General Public License is intended to guarantee your "
                "freedom to share and change free software"),
    ("GPL-2.0", _GPL_NOTICE.format("General Public License", "2")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds "
                "of works."),
    ("GPL-3.0", _GPL_NOTICE.format("General Public License", "3")),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("ISC", _ISC_END),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GPL_NOTICE.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GPL_NOTICE.format("Lesser General Public License", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("MIT", _MIT_START),
    ("MIT", _MIT_END),
    ("MIT", f"{_MIT_START} {_MIT_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
                "copy of the MPL was not distributed with this file, You can obtain one at "
                "http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will "
             "the authors be held liable for any damages arising from the use of this software."),
)


def _all_templates() -> tuple[tuple[str, str], ...]:
    """The texts, and for every license its names in the usual notices and its tags."""
    found = list(TEXTS)
    named = [(spdx, names, ("", "-only", "-or-later")) for spdx, names in LICENSES]
    for short, long in _COMMONS.items():
        for version, kind in _COMMONS_VERSIONS:
            named.append((f"CC-{short}-{version}", (
                f"CC {short} {version}", f"CC-{short}-{version}",
                f"Creative Commons {long} {version} {kind} License",
                f"Creative Commons {long} {version} License"), ("",)))
    for spdx, names, endings in named:
        found += [(spdx, frame.format(name)) for name in names for frame in _FRAMES]
        found += [(spdx, _FIELD.format(re.sub(",? License", "", name))) for name in names]
        found += [(spdx, _TAG.format(spdx + ending)) for ending in endings]
    return tuple(dict.fromkeys(found))


TEMPLATES = _all_templates()
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_FILE_NAME = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$", re.I)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")


def sections(text: str) -> Iterator[list[str]]:
    """The words of each sentence of a line, each line, each paragraph of several lines, and the text."""
    paragraph: list[list[str]] = []
    whole: list[str] = []
    n_lines = 0
    for line in [*text.split("\n"), ""]:
        sentences = [words for piece in _SENTENCE.split(line) if (words := words_of(piece))]
        if sentences:
            words = sentences[0] if len(sentences) == 1 else [w for part in sentences for w in part]
            if len(sentences) > 1:
                yield from sentences
            yield words
            paragraph.append(words)
            whole += words
            n_lines += 1
        else:
            if len(paragraph) > 1:
                yield [w for line in paragraph for w in line]
            paragraph = []
    if n_lines > 1:
        yield whole


class Matcher:
    """The templates as vectors; weights come from counts over all lines."""

    def __init__(self, templates, lines: int, held: dict[str, int]) -> None:
        self.rare = math.log(1 + max(lines, 1)) + 1
        self.weight = {
            word: math.log((1 + lines) / (1 + held.get(word, 0))) + 1
            for _, text in templates for word in words_of(text)
        }
        self.templates = []
        for name, text in sorted(templates):
            vector = self.vector(words_of(text))
            self.templates.append((name, vector, math.sqrt(sum(x * x for x in vector.values()))))
        self.known = frozenset(self.weight)
        # By Cauchy and Schwarz a cosine is at most the share of the template's length in common words.
        # Without a template's rarest words the rest of it is too short; so a section, and a text,
        # that holds no such word of any template is near none.
        telling = set()
        for _, vector, size in self.templates:
            rest = size * size
            for word in sorted(vector, key=lambda w: (-self.weight[w], w)):
                if rest < MIN_COSINE ** 2 * size * size * (1 - 1e-9):
                    break
                telling.add(word)
                rest -= vector[word] ** 2
        self.telling = frozenset(telling)

    def vector(self, words: list[str]) -> dict[str, float]:
        return {w: n * self.weight.get(w, self.rare) for w, n in Counter(words).items()}

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine of a section that speaks for a license, and that license."""
        best = (0.0, None)
        lower = text.lower()
        if not any(word in lower for word in self.telling) or self.telling.isdisjoint(words_of(text)):
            return best
        for words in sections(text):
            if self.telling.isdisjoint(words):
                continue
            distinct = set(words)
            shared = distinct & self.known
            if not shared:
                continue
            # No template can be nearer than the part of the section in template words;
            # the other part is at least as long as if each of its words stood there once.
            outside = (len(distinct) - len(shared)) * self.rare ** 2
            counts = Counter(words) if len(words) > 8 else None
            inside = sum(((counts[w] if counts else words.count(w)) * self.weight[w]) ** 2 for w in shared)
            if inside < MIN_COSINE ** 2 * (inside + outside):
                continue
            cosine, name = self._nearest(self.vector(words), shared)
            if name is not None and (-cosine, name) < (-best[0], best[1] or ""):
                best = (cosine, name)
        return best

    def _nearest(self, own: dict[str, float], shared: set[str]) -> tuple[float, str | None]:
        """The license of the nearest template; none if it is too far or another one is as near."""
        norm = math.sqrt(sum(x * x for x in own.values()))
        ordered = sorted(shared)
        by_license: dict[str, float] = {}
        for name, vector, size in self.templates:
            dot = math.fsum(own[w] * vector[w] for w in ordered if w in vector)
            by_license[name] = max(by_license.get(name, 0.0), round(dot / (norm * size), 9))
        first, second = sorted(((-c, name) for name, c in by_license.items()))[:2]
        if -first[0] < MIN_COSINE or second[0] - first[0] < MARGIN:
            return 0.0, None
        return -first[0], first[1]


def _line_counts(source: DataFrame, known: frozenset) -> tuple[int, dict[str, int]]:
    """Number of lines with words, and for each template word the lines that hold it."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                for line in (text or "").split("\n"):
                    words = words_of(line)
                    if words:
                        counts[None] += 1
                        counts.update(known.intersection(words))
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(list(counts), pa.string()),
            "n": pa.array(list(counts.values()), pa.int64())})

    # As many rows as template words, at most, come to the driver.
    rows = source.mapInArrow(lean(counted), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).collect()
    held = {r["word"]: r["n"] for r in rows}
    return held.pop(None, 0), held


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text",
         templates=TEMPLATES) -> DataFrame:
    """All columns of ``files`` but the text, with license, cosine, origin and licensed_by.

    ``origin`` is "own" or "inherited", ``licensed_by`` the directory inherited from.
    Columns of these names are replaced.
    """
    results = ("license", "cosine", "origin", "licensed_by")
    names = [c for c in files.columns if c not in (*results, text_col)]
    source = files.select(F.col(text_col).alias("text"))
    matcher = Matcher(templates, *_line_counts(source, frozenset(
        w for _, text in templates for w in words_of(text))))
    packed = files.select(F.struct(*names).alias("row"), F.col(path_col).alias("path"),
                          F.col(text_col).alias("text"))
    schema = T.StructType([
        packed.schema["row"], T.StructField("path", T.StringType()), T.StructField("own", T.StringType()),
        T.StructField("cosine", T.DoubleType()), T.StructField("is_file", T.BooleanType())])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, is_file = [], []
            for text, path in zip(batch["text"], batch["path"]):
                text, path = text.as_py() or "", path.as_py()
                own.append(matcher.best(text))
                is_file.append(own[-1][1] is not None and path is not None and bool(
                    _FILE_NAME.search(path) or len(words_of(text)) <= FILE_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["path"], pa.array([n for _, n in own], pa.string()),
                 pa.array([c if n else None for c, n in own], pa.float64()), pa.array(is_file, pa.bool_())],
                names=schema.names)

    # The texts are matched once; only short columns are stored and shuffled.
    found = saved(packed.mapInArrow(lean(matched), schema).withColumn(
        "dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "matched")
    licensed = saved(
        found.where("is_file").select(F.col("dir").alias("__dir"), "own", "cosine").groupBy("__dir").agg(
            F.min_by("own", F.struct(-F.col("cosine"), F.col("own"))).alias("license")),
        "licensed")
    inherited = saved(_inherited(found.select("dir"), licensed), "inherited")
    joined = found.join(inherited, "dir", "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.coalesce("own", "__license").alias("license"),
        F.col("cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(
            F.col("__license").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("__from")).alias("licensed_by"))


def _inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """dir, __license, __from: the nearest licensed directory at or above each directory."""
    distinct = directories.where("dir is not null").distinct()
    levels = F.split("dir", "/")
    above = distinct.select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(levels)),
        lambda n: F.array_join(F.slice(levels, 1, n), "/"))).alias("__dir"))
    above = above.unionAll(distinct.where("dir <> ''").select("dir", F.lit("").alias("__dir")))
    nearest = above.join(licensed, "__dir").groupBy("dir").agg(
        F.max_by(F.struct("license", "__dir"), F.length("__dir")).alias("it"))
    return nearest.select("dir", F.col("it.license").alias("__license"),
                          F.col("it.__dir").alias("__from"))
