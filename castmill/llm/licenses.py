"""Licence scan with a positional index of rare words; DataFrame functions only.

A template is a whole short licence text (MIT, BSD, ISC, Unlicense, zlib, Boost), the notice that a longer licence asks for
in each file, or a line that names a licence; it has one mandatory key phrase. The index has the places of every
template word; a word's IDF is over the templates, so no pass over the documents is needed for it. A key's
two words of highest IDF are its index terms. A file is looked up only if it has both index terms of some
template; then those of its licence words are looked up whose IDF is at least that of the least index term
of its possible templates, the file's highest-IDF licence words. Their places in the file, less their places
in the templates, are intersected: where two meet, a template may lie. There the key phrase is verified word
by word, and the share of all the template's words that stand where they should is its score. Each place of a
key phrase has both its index terms at the right distance, so none is missed. Work beyond the first look grows
with the licence words that files hold, not with the number of templates.

Null and empty texts have no words, score 0 and empty labels. Repeated rows and rows without an id are
scanned each by itself; ties of score don't matter, as the largest is reported. An empty table gives an empty
result. Only the id and text columns are read.
"""

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the contract with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, mandatory key phrase, licence text or notice. The first of each base label is its notice.
TEMPLATES = [
    ("mit", "under the mit license", "released under the MIT License"),
    ("apache-2", "apache license version 2", "licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "you may not use this file except in compliance with the license", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("bsd", "redistribution and use in source and binary forms", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("isc", "the isc license", "licensed under the ISC License"),
    ("gpl-3", "gnu general public license version 3", "licensed under the GNU General Public License version 3"),
    ("gpl-2", "gnu general public license version 2", "licensed under the GNU General Public License version 2"),
    ("gpl", "under the terms of the gnu general public license", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details."""),
    ("lgpl", "gnu lesser general public license", """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
        General Public License for more details."""),
    ("agpl", "gnu affero general public license", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details."""),
    ("mpl-2", "mozilla public license", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "free and unencumbered software released into the public domain", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/"""),
    ("zlib", "altered source versions must be plainly marked as such", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution."""),
    ("bsl-1", "boost software license", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1", "obtaining a copy of the software and accompanying documentation covered by this license", """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
        this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
        EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
        WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("cc0", "cc0 1 0", "dedicated to the public domain under CC0 1.0"),
    ("cc-by-sa", "cc by sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


KEYS, TEXTS = [k.split() for _, k, _ in TEMPLATES], [words_of(t) for _, _, t in TEMPLATES]
#: Where a template's key phrase begins in it.
AT = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for k, t in zip(KEYS, TEXTS)]
#: The notices whose key phrases are the base.
BASE_TEMPLATES = [next(i for i, k in enumerate(KEYS) if k == phrase.split()) for phrase in BASE]


def inverse_frequency() -> dict[str, float]:
    seen = Counter(w for t in TEXTS for w in set(t))
    return {w: round(math.log(len(TEXTS) / n), 6) for w, n in seen.items()}


def index_terms(phrase: list[str], idf: dict[str, float]) -> list[str]:
    """The two words of highest IDF in a key phrase."""
    return sorted(dict.fromkeys(phrase), key=lambda w: -idf[w])[:2]


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _candidates(words: Column, looked: Column) -> Column:
    """Template and start of its key phrase, where two places of looked-up words agree on it."""
    postings = {}
    for t, (text, at) in enumerate(zip(TEXTS, AT)):
        for i, w in enumerate(text):
            postings.setdefault(w, []).append({"t": t, "at": i - at})
    index = _literal(postings, "map<string,array<struct<t:int,at:int>>>")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(looked, h["w"]))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.try_element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start")))))
    met = lambda a: F.filter(a, lambda x, i: x.eqNullSafe(F.get(a, i - 1)) & ~x.eqNullSafe(F.get(a, i - 2)))
    return _let(F.array_sort(F.filter(starts, lambda x: x["start"] >= 0)), met)


def _verified(words: Column, candidates: Column) -> Column:
    """Candidates whose key phrase stands there, with the share of the template's words that do."""
    keys, whole, ats = _literal(KEYS, "array<array<string>>"), _literal(TEXTS, "array<array<string>>"), _literal(AT, "array<int>")
    found = F.filter(candidates, lambda c: _let(F.get(keys, c["t"]), lambda key: F.slice(words, c["start"] + 1, F.size(key)) == key))

    def score(c, text, first):
        skip = F.greatest(-first, F.lit(0))  # the file begins within the template
        pairs = F.zip_with(F.slice(words, first + skip + 1, F.size(text) - skip), F.slice(text, skip + 1, F.size(text) - skip), lambda x, y: x.eqNullSafe(y))
        return F.size(F.filter(pairs, lambda same: same)) / F.size(text)

    scored = lambda c: _let(F.get(whole, c["t"]), lambda text: _let(c["start"] - F.get(ats, c["t"]), lambda first: score(c, text, first)))
    return F.transform(found, lambda c: F.struct(c["t"].alias("template"), c["start"].alias("start"), scored(c).alias("score")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, found array<struct<template, start, score, label>>: every verified place of every template's key phrase."""
    idf = inverse_frequency()
    terms = [index_terms(k, idf) for k in KEYS]
    rows = texts(docs, id_col, text_col).select("doc_id", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    own = F.array_intersect("words", _literal(sorted({w for t in terms for w in t}), "array<string>"))
    # Possible templates by their two index terms, each with the lesser IDF of both.
    pairs = _literal([{"a": a, "b": b, "idf": min(idf[a], idf[b])} for a, b in terms], "array<struct<a:string,b:string,idf:double>>")
    possible = _let(own, lambda own: F.filter(pairs, lambda p: F.array_contains(own, p["a"]) & F.array_contains(own, p["b"])))
    rows = rows.select("doc_id", "words", F.array_min(F.transform(possible, lambda p: p["idf"])).alias("least"))
    ranked = _literal([{"w": w, "idf": v} for w, v in idf.items()], "array<struct<w:string,idf:double>>")
    looked = F.transform(F.filter(ranked, lambda r: r["idf"] >= F.col("least")), lambda r: r["w"])
    found = _let(F.array_intersect("words", looked), lambda some: _verified(F.col("words"), _candidates(F.col("words"), some)))
    labels = _literal([label for label, *_ in TEMPLATES], "array<string>")
    labelled = F.transform(found, lambda f: F.struct(f["template"].alias("template"), f["start"].alias("start"), f["score"].alias("score"), F.get(labels, f["template"]).alias("label")))
    none = F.array().cast("array<struct<template:int,start:int,score:double,label:string>>")
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("least").isNotNull(), labelled).otherwise(none).alias("found"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["template"].isin(BASE_TEMPLATES))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    return scan.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        join("base").alias("base_labels"), join("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """Every key phrase at every place, without an index."""
    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    at, score = [], []
    for k, (key, text, off) in enumerate(zip(KEYS, TEXTS, AT)):
        at.append(f"CASE WHEN list_contains(w, '{key[0]}') THEN list_filter(range(len(w)), lambda s: w[s+1] = '{key[0]}' AND w[s+1:s+{len(key)}] = {lists(key)}) ELSE [] END AS at_{k}")
        same = f"list_sum(list_transform(range({len(text)}), lambda j: CASE WHEN s + j - {off} >= 0 AND w[s + j - {off} + 1] = ({lists(text)})[j + 1] THEN 1 ELSE 0 END))"
        score.append(f"CASE WHEN len(at_{k}) > 0 THEN list_max(list_transform(at_{k}, lambda s: {same} / {len(text)}.0::DOUBLE)) END")
    starts = " || ".join(f"at_{k}" for k in BASE_TEMPLATES)
    labels = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{TEMPLATES[k][0]}' END" for k in ks) + "], lambda x: x IS NOT NULL))), ',')"
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
a AS (SELECT doc_id, w, {", ".join(at)} FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len({starts})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word, list_max({starts})::BIGINT AS last_word,
{labels(BASE_TEMPLATES)} AS base_labels, {labels(range(len(TEMPLATES)))} AS labels, coalesce(greatest({", ".join(score)}), 0.0)::DOUBLE AS score FROM a"""


ORACLE_SQL = _sql()
