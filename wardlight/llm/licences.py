"""Licence scan by a positional index of rare words.

Each template is a licence's text or notice. Over the corpus, document frequencies of the templates' words
give their IDF, and the index posts each template's ``2 * rare`` rarest words with their positions. In a file, the
``rare`` words of highest IDF among those that it has of a template vote for starts of the template in the file (place
less position). Where all but one of them agree within ``slack`` (a tenth of the template, so that inserted or lost words
do no harm), the mandatory key phrases are verified in the words from there to the template's end, ``slack`` more on
either side. The score is the part of the template's words, weighed by IDF, that stand there in order.

Besides, places of fixed phrases are counted.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. Cases: null and
empty texts have no words, no labels and score 0; repeated rows each get a row; an empty table
gives no rows; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU %sGeneral Public License for more details. "
)


def gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {GNU_TAIL % name}"


# Licence texts and notices (public) with their key phrases.
TEMPLATES = {
    "apache-2.0": [
        ("Licensed under the Apache License, Version 2.0", ["apache license", "2 0"]),
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
            "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
            "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
            ["except in compliance", "apache org licenses"],
        ),
    ],
    "mit": [
        ("Released under the MIT License", ["mit license"]),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            f"Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
            ["free of charge", "associated documentation files", "above copyright notice"],
        ),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["free of charge", "associated documentation files"]),
    ],
    "gpl-2.0": [(gnu("", "2"), ["gnu general public license", "free software foundation", "version 2 of the license"])],
    "gpl-3.0": [
        ("licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
        (gnu("", "3"), ["gnu general public license", "free software foundation", "version 3 of the license"]),
    ],
    "gpl": [("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license", "free software foundation"])],
    "lgpl": [("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]), (gnu("Lesser ", "3"), ["gnu lesser general public license"])],
    "agpl-3.0": [(gnu("Affero ", "3"), ["gnu affero general public license"])],
    "mpl-2.0": [
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            ["mozilla public license", "v 2 0"],
        )
    ],
    "epl-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ["eclipse public license"])],
    "bsd-2-clause": [(BSD_HEAD + BSD_TAIL, ["source and binary forms", "this list of conditions", "substitute goods or services"])],
    "bsd-3-clause": [(BSD_HEAD + BSD_NAMES + BSD_TAIL, ["source and binary forms", "this list of conditions", "endorse or promote products", "substitute goods or services"])],
    "bsd": [("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "permitted provided that"])],
    "isc": [
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
            "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
            ["with or without fee", "hereby granted", "author disclaims all warranties"],
        )
    ],
    "zlib": [
        (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
            "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
            "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
            "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
            ["must not be misrepresented", "plainly marked as such"],
        )
    ],
    "bsl-1.0": [
        (
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
            "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
            ["person or organization obtaining", "display distribute execute and transmit"],
        )
    ],
    "unlicense": [
        (
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
            "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            ["free and unencumbered software", "public domain"],
        ),
        ("This is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ],
    "wtfpl": [("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ["verbatim or modified copies", "as long as the name is changed"])],
    "cc-by-nc-4.0": [("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"])],
    "cc-by-4.0": [
        ("Licensed under CC BY 4.0", ["cc by 4 0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ],
    "cc-by-sa-4.0": [("Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"])],
    "cc0-1.0": [("CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0", "public domain"])],
}

#: A byte of a word as its lower case, any other as a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]


def templates() -> list[Template]:
    return [Template(label, tuple(words_of(text)), tuple(tuple(words_of(k)) for k in keys)) for label, notices in TEMPLATES.items() for text, keys in notices]


def word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows of the whole table and, for each word of the templates, in how many of them it stands.

    The driver gets a row for each template word, whatever the table's size.
    """
    known = {w for t in templates() for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, dict.fromkeys(known, 0)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                for w in known.intersection(words_of(text)):
                    found[w] += 1
        found[b""] = rows
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    seen = {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return seen.pop(b"", 0), seen


def in_order(places: dict[bytes, list[int]], words: tuple[bytes, ...], weight: dict[bytes, float]) -> float:
    """Weight of the heaviest run of ``words``, in order, at rising ``places`` (each word's, rising)."""
    end = 1 + max((p[-1] for p in places.values()), default=0)
    tree = [0.0] * (end + 1)  # the heaviest run that ends before a place, by a binary indexed tree of maxima
    for w in words:
        for at in reversed(places.get(w, ())):  # a word of the template takes one place
            best, k = 0.0, at
            while k > 0:
                best = max(best, tree[k])
                k &= k - 1
            best += weight[w]
            k = at + 1
            while k <= end:
                tree[k] = max(tree[k], best)
                k += k & -k
    return max(tree)


def places_in(words: list[bytes], wanted: frozenset[bytes] | set[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for at, w in enumerate(words):
        if w in wanted:
            found.setdefault(w, []).append(at)
    return found


class RareIndex:
    """Postings of each template's ``2 * rare`` words of highest IDF, with positions."""

    def __init__(self, rows: int, frequency: dict[bytes, int], rare: int = 4):
        self.templates, self.rare = templates(), rare
        self.idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for t in self.templates for w in t.words}
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        self.needed, self.slack, self.weight = [], [], []
        for k, t in enumerate(self.templates):
            chosen = sorted(set(t.words), key=self.rank)[: 2 * rare]
            self.needed.append(max(1, min(len(chosen), rare) - 1))  # one rare word may be changed
            self.slack.append(max(2, len(t.words) // 10))
            self.weight.append(sum(self.idf[w] for w in t.words))
            for at, w in enumerate(t.words):
                if w in chosen:
                    self.postings.setdefault(w, {}).setdefault(k, []).append(at)
        self.words = frozenset(self.postings)

    def rank(self, word: bytes) -> tuple[float, bytes]:
        return -self.idf[word], word

    def found(self, words: list[bytes]) -> dict[str, float]:
        """Labels of a file with the best score of each."""
        own = self.words.intersection(words)
        if not own:
            return {}
        voters: dict[int, list[bytes]] = {}
        for w in sorted(own, key=self.rank):  # the file's rarest words first
            for k in self.postings[w]:
                if len(chosen := voters.setdefault(k, [])) < self.rare:
                    chosen.append(w)
        voters = {k: chosen for k, chosen in voters.items() if len(chosen) >= self.needed[k]}
        places = places_in(words, {w for chosen in voters.values() for w in chosen}) if voters else {}
        best: dict[str, float] = {}
        for k, chosen in voters.items():
            for low, high in self.agreed(k, chosen, places):
                area = words[max(0, low - self.slack[k]) : high + len(self.templates[k].words) + self.slack[k]]
                if self.keys_stand(k, area):
                    t = self.templates[k]
                    best[t.label] = max(best.get(t.label, 0.0), in_order(places_in(area, set(t.words)), t.words, self.idf) / self.weight[k])
        return best

    def agreed(self, k: int, chosen: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """Least and largest start of each run of votes within ``slack`` in which enough words agree."""
        votes = sorted({(at - place, w) for w in chosen for at in places[w] for place in self.postings[w][k]})
        found, first, held = [], 0, Counter()
        for last, (start, word) in enumerate(votes):
            held[word] += 1
            while start - votes[first][0] > self.slack[k]:
                held[votes[first][1]] -= 1
                if not held[votes[first][1]]:
                    del held[votes[first][1]]
                first += 1
            if len(held) >= self.needed[k]:
                if found and found[-1][0] == votes[first][0]:
                    found.pop()
                found.append((votes[first][0], votes[last][0]))
        return found

    def keys_stand(self, k: int, area: list[bytes]) -> bool:
        joined = b" " + b" ".join(area) + b" "
        return all(b" " + b" ".join(key) + b" " in joined for key in self.templates[k].keys)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word number and label of each place where a base phrase stands."""
    joined, places = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        number, counted = 0, 0
        while at >= 0:
            number += joined.count(b" ", counted, at)
            places.append((number, label))
            counted, at = at, joined.find(sought, at + 1)
    return places


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 4) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``places`` (word and label of base phrases) and ``found`` (label and score by the index)."""
    index = RareIndex(*word_frequencies(docs, text_col), rare)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    label = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                places.append([{"word": n, "label": s} for n, s in sorted(phrase_places(words))])
                found.append([{"label": k, "score": min(1.0, v)} for k, v in sorted(index.found(words).items())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(found, label)], names=[id_col, "n_words", "places", "found"])

    shape = f"`{id_col}` {kind}, n_words long, places array<struct<word:long,label:string>>, found array<struct<label:string,score:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last base place, labels and the best score; base phrases alone score 0.5."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda f: f["label"]))))
    best = F.greatest(F.when(F.size("places") > 0, F.lit(0.5)).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)))
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        best.alias("score"),
    )
