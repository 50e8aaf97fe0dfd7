"""License scans by an exact set-similarity join of text blocks with license templates.

A template's blocks are the runs of as many consecutive words as it has and an eighth more, one starting at every
word. Pass one counts in how many documents each template word stands; rarest first is the global order. Pass two
joins: a block that holds `need` of a template's words holds one of its first (size - need + 1) words in that order
(prefix filter), so only blocks around those are looked at; they need `need` places of template words at all (length
filter), and a word that opens a block's common words can't stand later in the order than `need` words before the
template's end (positional filter). What passes is counted in full while the block slides word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import PUNCT, column, in_batches, slices, table, texts_of

# Base phrases and labels, and the notices and texts by which licenses are recognised.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
THRESHOLD = 0.9

_TO_WORDS = bytes(0x20 if b in PUNCT else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def block_length(template_words: int) -> int:
    return template_words + template_words // 8


@dataclass
class Templates:
    """Templates as word sets in the global order, and the first words by which they are found."""

    names: list[str]
    sets: list[dict[bytes, int]]  # word -> place in the order
    need: list[int]
    length: list[int]
    prefix: dict[bytes, list[int]]  # word -> templates of whose prefix it is

    @classmethod
    def ordered(cls, templates: dict[str, str], threshold: float, frequency: dict[bytes, int]) -> Templates:
        own = {k: words_of(t) for k, t in templates.items()}
        names = [k for k, ws in own.items() if ws]
        sets = [{w: i for i, w in enumerate(sorted(set(own[k]), key=lambda w: (frequency.get(w, 0), w)))} for k in names]
        need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        prefix: dict[bytes, list[int]] = {}
        for t, (s, n) in enumerate(zip(sets, need, strict=True)):
            for w, i in s.items():
                if i <= len(s) - n:
                    prefix.setdefault(w, []).append(t)
        return cls(names, sets, need, [block_length(len(own[k])) for k in names], prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, most common words) of each stretch of blocks that meet a threshold."""
        out = []
        for t in sorted({t for w in self.prefix.keys() & set(words) for t in self.prefix[w]}):
            own, need, length = self.sets[t], self.need[t], self.length[t]
            places = [(i, w) for i, w in enumerate(words) if w in own]
            if len(places) < need:
                continue
            last_first = len(own) - need
            near = -length  # place of the last prefix word
            held: Counter = Counter()
            head = 0
            found: list[list[int]] = []
            # the next prefix word at or after each place
            ahead = [0] * len(places)
            following = len(words) + length
            for k in range(len(places) - 1, -1, -1):
                if own[places[k][1]] <= last_first:
                    following = places[k][0]
                ahead[k] = following
            for k, (i, w) in enumerate(places):
                held[w] += 1
                while places[head][0] <= i - length:
                    gone = places[head][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    head += 1
                if own[w] <= last_first:
                    near = i
                if i - near >= length and ahead[k] - i >= length:
                    continue  # no block around here holds a prefix word
                if k - head + 1 >= need and len(held) >= need:
                    start = places[head][0]
                    if found and start < found[-1][1]:
                        found[-1][1], found[-1][2] = i + 1, max(found[-1][2], len(held))
                    else:
                        found.append([start, i + 1, len(held)])
            out += [(t, a, b, n) for a, b, n in found]
        return out


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of the templates stands: as many rows as they have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for text in column(batch, "text").to_pylist():
                    counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = in_batches(texts_of(docs).select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))


def places(words: list[bytes], phrase: Sequence[bytes]) -> list[int]:
    """Starts of the phrase, found from its last word."""
    out, n, at = [], len(phrase) - 1, -1
    for _ in range(words.count(phrase[-1])):
        at = words.index(phrase[-1], at + 1)
        if at >= n and words[at - n : at] == list(phrase[:-1]):
            out.append(at - n)
    return out


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    matches (label, first word, end word, containment) of all stretches of blocks that meet the threshold.

    score is the highest containment of a template in a block, 1 where a base phrase stands. Null and
    wordless texts have no words, no labels and score 0; long texts are scanned whole; ties keep every label; rows that
    repeat a doc_id are scanned each; an empty table gives no rows; extra columns are ignored. The templates are a
    parameter that goes to every task, so they should stay within some ten thousand.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = frozenset(w for t in templates.values() for w in words_of(t))
    frequency = word_frequency(docs, vocabulary)
    base = [(tuple(words_of(p)), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates.ordered(templates, threshold, frequency)
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                    words = words_of(text)
                    found = sorted((p, label) for phrase, label in base for p in places(words, phrase))
                    matches = [{"label": index.names[t], "word": a, "end": b, "containment": n / len(index.sets[t])} for t, a, b, n in index.matches(words)]
                    bases = sorted({x for _, x in found})
                    labels = sorted({*bases, *(m["label"] for m in matches)})
                    score = 1.0 if found else max((m["containment"] for m in matches), default=0.0)
                    rows.append((doc, len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(bases), ",".join(labels), score, matches))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return in_batches(texts_of(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, word: long, end: long, containment: double>>")


SCHEMA = pa.schema(
    [
        *((n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))),
    ]
)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("matches")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_license_scan that SQL can say."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_PHRASE = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items())
ORACLE_SQL: dict[str, str] = {
    "license_base": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({_PHRASE}),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(s, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""
}
QUERIES = {"op2_license_scan": op2_license_scan, "license_base": license_base}
