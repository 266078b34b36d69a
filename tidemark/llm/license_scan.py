"""License scans: a positional index of rare licence words, checked by key phrases.

Words are runs of characters other than ASCII ones that are neither letters nor
digits, after A-Z are lower-cased.  Base labels come from places where a base phrase's
words stand consecutively.  The method adds labels.  Templates are whole licences, their
notices and short characteristic sentences; the index has the places (template, position)
of each template word whose inverse document frequency over the whole corpus is at
least ``LEAST_IDF`` (of a template with fewer than ``AGREE`` such words, those of highest
IDF).  All index words of a file are looked up; each place proposes a start of its template in the file
(position in file minus position in template).  Proposals are sorted, and a start that
``AGREE`` places share (all, if there are fewer) is a candidate; the template's mandatory key phrase must stand at its place
from that start.  The score of a file is the largest IDF-weighted part of a template's
index words that stands in place at a verified start (1 for a base place, 0 without any).

All of it is DataFrame functions on one row at a time; the one aggregate is a count of
documents for each template word (a fixed number of rows on the driver).

Defined results: null and empty texts have no words and no labels; repeated rows get
equal results; very long texts, also of licence words alone, take time n log n and memory
in proportion (a word has at most as many places as the templates have of it); extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AGREE = 2
#: A word in at most half of the documents has an IDF of at least this.
LEAST_IDF = 0.69
#: Cells of the index, so that a word is compared with few others.
CELLS = 256

# Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Texts of licences and of their notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
# Label, text, mandatory key phrase within it.
TEMPLATES = [
    ("mit", _MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the MIT License", "mit license"),
    ("mit", "licensed under the MIT License", "mit license"),
    ("bsd", _BSD, "redistribution and use in source and binary forms"),
    ("bsd", _BSD_END, "provided by the copyright holders and contributors as is"),
    ("isc", _ISC, "permission to use copy modify and or distribute this software"),
    ("zlib", _ZLIB, "permission is granted to anyone to use this software for any purpose"),
    ("apache-2.0", _APACHE, "apache license"),
    ("apache-2.0", "licensed under the Apache License Version 2.0", "apache license"),
    ("gpl", _GPL.format("", ""), "gnu general public license"),
    ("gpl", "this work is licensed under the GNU General Public License version 3", "gnu general public license"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("lgpl", _GPL.format("Lesser ", "Lesser "), "gnu lesser general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("agpl", _GPL.format("Affero ", "Affero "), "gnu affero general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    ("mpl-2.0", _MPL, "mozilla public license"),
    ("boost", _BOOST, "free of charge to any person or organization"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law, the author has waived all copyright CC0 1.0 Universal", "cc0 1 0 universal"),
    ("unlicense", _UNLICENSE, "free and unencumbered software"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    ("reserved", "Copyright. All rights reserved", "all rights reserved"),
]


def split(phrase: str) -> list[str]:
    """Words of a text on the driver."""
    return [w for w in re.split(SPLIT, phrase.lower()) if w]


@dataclass(frozen=True)
class Template:
    label: str
    words: list[str]
    key: list[str]
    offset: int


def _template(label: str, text: str, key: str) -> Template:
    parts, needed = split(text), split(key)
    return Template(label, parts, needed, next(k for k in range(len(parts)) if parts[k : k + len(needed)] == needed))


_TEMPLATES = [_template(*t) for t in TEMPLATES]
VOCABULARY = sorted({w for t in _TEMPLATES for w in t.words} | {w for phrase in BASE for w in split(phrase)})


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), "")


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each template word."""
    found = docs.select(F.array_intersect(F.array(*[F.lit(w) for w in VOCABULARY]), words(F.col("text"))).alias("w"))
    rows = found.select(F.explode_outer(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


class Index:
    """Places of index words as literals of a plan."""

    def __init__(self, idf: dict[str, float]):
        self.idf = idf
        places: dict[str, list[tuple[int, int]]] = {}
        needs, kept = [], []
        for t, template in enumerate(_TEMPLATES):
            order = sorted(set(template.words), key=lambda w: (-idf[w], w))
            chosen = {w for w in order if idf[w] >= LEAST_IDF}
            if len(chosen) < AGREE:
                chosen = set(order[:AGREE])
            at = [(p, w) for p, w in enumerate(template.words) if w in chosen]
            needs.append(min(AGREE, len(at)))
            kept.append(at)
            for p, w in at:
                places.setdefault(w, []).append((t, p))
        self.vocabulary = sorted(set(places) | {self.pivot(phrase)[1] for phrase in BASE})
        cells: list[list[Column]] = [[] for _ in range(CELLS)]
        for w, found in sorted(places.items()):
            postings = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found])
            cells[zlib.crc32(w.encode()) % CELLS].append(F.struct(F.lit(w).alias("w"), postings.alias("at")))
        kind = "array<struct<w: string, at: array<struct<t: int, p: int>>>>"
        self.cells = F.array(*[F.array(*c).cast(kind) if c else F.expr(f"cast(array() as {kind})") for c in cells])
        self.templates = F.array(
            *[
                F.struct(
                    F.lit(x.label).alias("label"),
                    F.array(*map(F.lit, x.key)).alias("key"),
                    F.lit(x.offset).alias("offset"),
                    F.lit(needs[t]).alias("needs"),
                    F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for p, w in kept[t]]).alias("words"),
                    F.lit(sum(idf[w] for _, w in kept[t])).alias("total"),
                )
                for t, x in enumerate(_TEMPLATES)
            ]
        )

    def pivot(self, phrase: str) -> tuple[int, str]:
        """Position and word of highest IDF of a base phrase."""
        parts = split(phrase)
        k = max(range(len(parts)), key=lambda k: (self.idf[parts[k]], -k))
        return k, parts[k]

    def places(self, word: Column) -> Column:
        """array<struct<t, p>> of a word."""
        cell = F.get(self.cells, F.pmod(F.crc32(word), F.lit(CELLS)).cast("int"))
        return F.flatten(F.transform(F.filter(cell, lambda x: x["w"] == word), lambda x: x["at"]))


def _stand(w: Column, at: Column, phrase: Column) -> Column:
    """Whether the words ``phrase`` stand in w from position ``at`` on."""
    return F.when(at >= 0, F.slice(w, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase).otherwise(False)


def _verified(w: Column, hits: Column, index: Index) -> Column:
    """array<struct<label, score>> of the templates' verified starts."""
    proposed = F.flatten(F.transform(hits, lambda z: F.transform(index.places(z["w"]), lambda x: F.struct(x["t"].alias("t"), (z["i"] - x["p"]).alias("s")))))

    def agreed(found: Column) -> Column:
        first = lambda x, k: F.coalesce(F.get(found, k - 1) != x, F.lit(True))
        enough = lambda x, k: (index.templates[x["t"]]["needs"] == 1) | F.coalesce(F.get(found, k + AGREE - 1) == x, F.lit(False))
        return F.filter(found, lambda x, k: first(x, k) & enough(x, k))

    def stands(x: Column) -> Column:
        return let(F.get(index.templates, x["t"]), lambda t: _stand(w, x["s"] + t["offset"], t["key"]))

    def scored(x: Column) -> Column:
        in_place = lambda s: lambda a, p: a + F.when(F.coalesce((s + p["p"] >= 0) & (F.get(w, s + p["p"]) == p["w"]), F.lit(False)), p["idf"]).otherwise(0.0)
        return let(F.get(index.templates, x["t"]), lambda t: F.struct(t["label"].alias("label"), (F.aggregate(t["words"], F.lit(0.0), in_place(x["s"])) / t["total"]).alias("score")))

    return let(F.sort_array(proposed), lambda found: F.transform(F.filter(agreed(found), stands), scored))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    total, counts = document_frequencies(docs)
    index = Index({w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) + 1e-6 for w in VOCABULARY})

    def of_words(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*index.vocabulary), F.struct(x.alias("w"), i.alias("i")))), lambda z: z.isNotNull())
        return let(hits, lambda h: F.struct(F.size(w).cast("long").alias("n"), F.when(F.size(h) > 0, of_hits(w, h)).alias("m")))

    def base_places(w: Column, h: Column, phrase: str) -> Column:
        k, rarest = index.pivot(phrase)
        starts = F.transform(F.filter(h, lambda z: z["w"] == rarest), lambda z: z["i"] - k)
        return F.filter(starts, lambda s: _stand(w, s, F.array(*map(F.lit, split(phrase)))))

    def of_hits(w: Column, h: Column) -> Column:
        base = F.array(*[F.struct(F.lit(name).alias("label"), base_places(w, h, phrase).alias("at")) for phrase, name in BASE.items()])
        return F.struct(F.filter(base, lambda z: F.size(z["at"]) > 0).alias("base"), _verified(w, h, index).alias("found"))

    df = docs.select("doc_id", let(words(F.col("text")), of_words).alias("r"))
    places = F.flatten(F.transform("r.m.base", lambda z: z["at"]))
    base_labels = F.coalesce(F.transform("r.m.base", lambda z: z["label"]), F.expr("cast(array() as array<string>)"))
    more = F.coalesce(F.transform("r.m.found", lambda z: z["label"]), F.expr("cast(array() as array<string>)"))
    text = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return df.select(
        "doc_id",
        F.col("r.n").alias("n_words"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        text(base_labels).alias("base_labels"),
        text(F.concat(base_labels, more)).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.least(F.coalesce(F.array_max(F.transform("r.m.found", lambda z: z["score"])), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
