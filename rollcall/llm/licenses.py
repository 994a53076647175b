"""Licence scan: lines, paragraphs and sentences against licence templates, in SQL functions alone.

A unit (a line, a paragraph of several lines, or one of several sentences of a paragraph) is normalised to lower-case
words; it matches a template if the Dice coefficient of their sets of word
bigrams reaches the threshold.  Dice can't reach it unless the sets' sizes lie
within a factor, so units are compared with the templates of a fitting size
only.  Nor can it without two thirds (at 0.8) of the template's bigrams: so of each template some words are
chosen that leave fewer bigrams than that without one of them, and only texts that hold such a
word are cut and normalised at all.  Everything happens in the row: there is no shuffle, and no copy of a
unit to be grouped.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: What is no word character and no line end.
BETWEEN, WORDS_END = r"[^\p{L}\p{N}\n]+", r"[^\p{L}\p{N}]+"
#: What parts paragraphs, and what parts sentences.
PARAGRAPH_ENDS, SENTENCE_ENDS = r"\n(?:[^\p{L}\p{N}\n]*\n)+", r"[.!?]+[ \t\n\f\r]"

# Words that too many texts hold to tell of a licence.
COMMON = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "do", "either", "following", "for", "from", "has", "have", "however", "in", "is", "it", "its", "may", "mit", "not", "of", "on", "one", "or", "other", "that", "the", "this", "to", "under", "use", "used", "version", "which", "with", "without", "work", "you", "your")

# Notices and paragraphs of public licences, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "You must give any other recipients of the Work or Derivative Works a copy of this License; and"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0-only", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "means any form of the work other than Source Code Form."),
    ("MPL-2.0", "This License represents the complete agreement concerning the subject matter hereof."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)

#: Licences and headers that stand in one block: the notices of these names that begin so, one after the other.
WHOLE = (
    ("MIT", (("MIT", "Permission"), ("MIT", "The above"), ("MIT", "THE SOFTWARE"))),
    ("Apache-2.0", (("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the"), ("Apache-2.0", "Unless"))),
    ("GPL-3.0-or-later", (("GPL-3.0-or-later", "This program is free"), ("GPL-3.0-or-later", "This program is distributed"))),
    ("GPL-2.0-or-later", (("GPL-2.0-or-later", "This program is free"), ("GPL-3.0-or-later", "This program is distributed"))),
    ("LGPL-3.0-or-later", (("LGPL-3.0-or-later", "This library is free"), ("LGPL-3.0-or-later", "This library is distributed"))),
    ("LGPL-2.1-or-later", (("LGPL-2.1-or-later", "This library is free"), ("LGPL-3.0-or-later", "This library is distributed"))),
    ("AGPL-3.0-or-later", (("AGPL-3.0-or-later", "This program is free"), ("AGPL-3.0-or-later", "This program is distributed"))),
    ("BSD-2-Clause", (("BSD-3-Clause", "Redistribution and"), ("BSD-2-Clause", "Redistributions of"), ("BSD-2-Clause", "Redistributions in"), ("BSD-2-Clause", "THIS"))),
    ("BSD-3-Clause", (("BSD-3-Clause", "Redistribution and"), ("BSD-2-Clause", "Redistributions of"), ("BSD-2-Clause", "Redistributions in"), ("BSD-3-Clause", "Neither"), ("BSD-2-Clause", "THIS"))),
    ("ISC", (("ISC", "Permission"), ("ISC", "THE"))),
)
#: Lines that name a licence by its identifier, one for each.
NAMED = tuple((licence, f"SPDX-License-Identifier: {licence}") for licence in dict.fromkeys(licence for licence, _ in NOTICES))
TEMPLATES = (*NOTICES, *NAMED, *((licence, " ".join(next(t for n, t in NOTICES if n == name and t.startswith(start)) for name, start in parts)) for licence, parts in WHOLE))


def word_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template (on the driver, for the fixed list only)."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set with which the Dice coefficient with one of size n can reach the threshold."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9), math.floor((2 - threshold) * n / threshold + 1e-9)


def tell_tale_words(templates, threshold: float) -> list[str]:
    """Words of which every unit that matches a template holds one.

    A match shares at least threshold / (2 - threshold) of the template's bigrams; words are
    taken, the one that lies in most bigrams still to be covered first (of equal ones the longest), until of each template
    fewer are without one.  Common words and single letters are taken only where nothing else is left.
    """
    left = {}
    for i, (_, text) in enumerate(templates):
        pairs = [set(p.split()) for p in word_bigrams(text)]
        left[i] = pairs, math.ceil(threshold * len(pairs) / (2 - threshold) - 1e-9)
    chosen: list[str] = []
    while left := {i: (pairs, need) for i, (pairs, need) in left.items() if len(pairs) >= max(need, 1)}:
        gain: Counter[str] = Counter()
        for pairs, need in left.values():
            own = Counter(word for pair in pairs for word in pair)
            gain.update({word: min(n, len(pairs) - need + 1) for word, n in own.items()})
        chosen.append(max(sorted(gain), key=lambda w: (len(w) > 1 and w not in COMMON, gain[w], len(w))))
        left = {i: ([p for p in pairs if chosen[-1] not in p], need) for i, (pairs, need) in left.items()}
    return chosen


def any_word(words: list[str]) -> str:
    """A pattern for texts in lower case that hold one of the words; told by the first letter, as most places fail there."""
    by_first = [(letter, [w[1:] for w in own]) for letter, own in groupby(sorted(words), key=lambda w: w[0])]
    branches = "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in by_first)
    return f"(?<![a-z0-9])(?=[{''.join(letter for letter, _ in by_first)}])(?:{branches})(?![a-z0-9])"


def template_array(templates, threshold: float) -> Column:
    """The templates as one literal: number, licence, size bounds and bigrams of each."""
    parts = []
    for i, (licence, text) in enumerate(templates):
        pairs = word_bigrams(text)
        low, high = size_bounds(len(pairs), threshold)
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(licence).alias("licence"), F.lit(len(pairs)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, pairs)).alias("pairs")))
    return F.array(*parts)


def licence_matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, unit, number, license, dice: a row for each unit that a template matches.

    Units are the lines of a text, numbered from 1, and its paragraphs (what lines
    without a letter or digit part, such as blank ones and marks of comments) of more
    than one line, numbered alike, and the sentences (parted by full stops, question or exclamation marks before white
    space), numbered through the text, of the paragraphs that hold several.  A unit has its best template; of equally
    good ones the first.  A null or empty text has no match, nor has a unit of fewer
    than two words.  Rows that repeat match each; an empty table gives no rows.
    """
    sizes = [size_bounds(len(word_bigrams(t)), threshold) for _, t in templates]
    least, most = min(a for a, _ in sizes), max(b for _, b in sizes)
    named = lambda kind, array: F.transform(array, lambda u, i: F.struct(F.lit(kind).alias("unit"), (i + 1).cast("long").alias("number"), u.alias("words")))
    # The text is normalised once, its line ends kept. Fields from a generator are not computed again where they are used.
    own = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(own)
    told = F.col("b.low").rlike(any_word(tell_tale_words(templates, threshold)))
    kept = lambda df, *gone: [c for c in df.columns if c not in gone]
    once = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], F.explode(F.array(F.struct(own.alias("own"), low.alias("low")))).alias("b")).where(told)
    body = F.regexp_replace("b.low", BETWEEN, " ")
    sentences = F.transform(F.split("b.own", PARAGRAPH_ENDS, -1), lambda p: F.split(p, SENTENCE_ENDS, -1))
    once = once.select(*kept(once, "b"), F.explode(F.array(F.struct(body.alias("body"), sentences.alias("said")))).alias("b"))
    once = once.select(*kept(once, "b"), "b.body", "b.said")
    lines = F.transform(F.split("body", "\n"), lambda u: F.trim(u))
    paragraphs = F.transform(F.split("body", "\n(?: ?\n)+"), lambda p: F.when(F.contains(p, F.lit("\n")), F.trim(F.regexp_replace(p, "[ \n]+", " "))).otherwise(""))
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), WORDS_END, " "))
    parts = F.flatten(F.transform("said", lambda of: F.transform(of, lambda x: F.when(F.size(of) > 1, plain(x)).otherwise(""))))
    units = once.select(*kept(once, "body", "said"), F.explode(F.filter(F.concat(named("line", lines), named("paragraph", paragraphs), named("sentence", parts)), lambda u: u["words"] != "")).alias("u"))
    units = units.select(*[c for c in units.columns if c != "u"], "u.unit", "u.number", "u.words")
    pairs_at_most = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    units = units.where(pairs_at_most >= least)
    split = F.split("words", " ")
    pairs = F.array_distinct(F.zip_with(F.slice(split, F.lit(1), F.size(split) - 1), F.slice(split, F.lit(2), F.size(split) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    # Bigrams that repeat make fewer: of units that are longer than any template only those with enough repeats stay.
    counted = units.select(*[c for c in units.columns if c != "words"], F.explode(F.array(F.struct(pairs.alias("pairs")))).alias("s"))
    counted = counted.select(*[c for c in counted.columns if c != "s"], F.col("s.pairs").alias("pairs"), F.size("s.pairs").alias("n")).where(F.col("n").between(least, most))
    dice = lambda t: 2.0 * F.size(F.array_intersect("pairs", t["pairs"])) / (F.col("n") + t["n"])
    fitting = F.filter(template_array(templates, threshold), lambda t: F.col("n").between(t["low"], t["high"]))
    scored = F.transform(fitting, lambda t: F.struct(dice(t).alias("dice"), (-t["i"]).alias("last"), t["licence"].alias("license")))
    best = F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))
    found = counted.select(*[c for c in counted.columns if c not in ("pairs", "n")], F.explode(F.filter(F.array(best), lambda s: s.isNotNull())).alias("best"))
    return found.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], "unit", "number", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))


def matches_sql() -> str:
    """DuckDB SQL for :func:`licence_matches` over ``documents`` with its defaults, comparing every unit with every template."""
    rows = ", ".join("({}, '{}', '{}')".format(i, licence, text.replace("'", "''")) for i, (licence, text) in enumerate(TEMPLATES))
    words = lambda x: rf"string_split(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH templates AS (SELECT i, license, {words("t")} AS w FROM (VALUES {rows}) AS v(i, license, t)),
tp AS (SELECT i, license, {pairs("w")} AS pairs FROM templates),
whole AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, 'line' AS unit, generate_subscripts(parts, 1) AS number, unnest(parts) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM whole)),
paragraphs AS (SELECT doc_id, 'paragraph' AS unit, generate_subscripts(parts, 1) AS number, unnest(parts) AS body FROM (SELECT doc_id, string_split_regex(text, '\n(?:[^\p{{L}}\p{{N}}\n]*\n)+') AS parts FROM whole)),
said AS (SELECT doc_id, string_split_regex(text, '{PARAGRAPH_ENDS}') AS parts FROM whole),
told AS (SELECT doc_id, flatten(list_transform(parts, lambda p: list_transform(string_split_regex(p, '{SENTENCE_ENDS}'), lambda x: {{'body': x, 'of': len(string_split_regex(p, '{SENTENCE_ENDS}'))}}))) AS parts FROM said),
sentences AS (SELECT doc_id, 'sentence' AS unit, generate_subscripts(parts, 1) AS number, unnest(parts) AS s FROM told),
units AS (SELECT row_number() OVER () AS u, * FROM (SELECT * FROM lines UNION ALL SELECT * FROM paragraphs WHERE contains(body, chr(10)) UNION ALL SELECT doc_id, unit, number, s.body FROM sentences WHERE s.of > 1)),
up AS (SELECT u, doc_id, unit, number, {pairs("w")} AS pairs FROM (SELECT *, {words("body")} AS w FROM units)),
scored AS (
  SELECT up.u, doc_id, unit, number, tp.i, license, 2.0::DOUBLE * len(list_intersect(up.pairs, tp.pairs)) / (len(up.pairs) + len(tp.pairs)) AS dice
  FROM up, tp WHERE len(up.pairs) > 0)
SELECT doc_id, unit, CAST(number AS BIGINT) AS number, license, dice
FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dice DESC, i) AS best FROM scored WHERE dice >= {THRESHOLD})
WHERE best = 1
"""
