"""Licence scans by a positional index of rare licence words.

The templates below are notices and paragraphs of licence bodies. The index
holds, for every licence word, the templates and positions where it stands, and
its IDF over all files. Per template the words of highest IDF are its anchors:
as many as leave less than LEAST of the template's IDF to the others, so a file
that matches has an anchor at its place, and none is missed. A file looks up
its anchors; each names a template at an offset (position in the file less
position in the template). There the postings are intersected by relative
position: the share of the template's IDF found is the score, and the template's
key phrase must stand whole. The base labels count fixed phrases.

Everything is DataFrame functions: one pass turns a text into the numbers of
its licence words (0 for other words), a count over all files gives the IDF,
and the look-up is a narrow step on these numbers, linear in text and matches.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, without

#: Phrase -> label of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and body paragraphs of public licences: (label, text, key phrase).
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 3 0 unported license", "creative commons attribution 3 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0"),
    ("cc-by-nc-sa-4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives 4 0"),
    ("apache-2.0", "licensed under the apache licence version 2 0", "apache licence version 2 0"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause license"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1", "spdx license identifier lgpl 2 1"),
    ("agpl-3.0", "spdx license identifier agpl 3 0", "spdx license identifier agpl 3 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 3 clause"),
    ("epl-2.0", "spdx license identifier epl 2 0", "spdx license identifier epl 2 0"),
    ("mpl-2.0", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights", "dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", "see the gnu lesser general public license for more details"),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version", "interacting with it remotely through a computer network"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "each contributor hereby grants to you a perpetual worldwide"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "in no event shall the authors or copyright holders be liable"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "provided by the copyright holders and contributors as is"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits", "the author disclaims all warranties with regard to this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "to alter it and redistribute it freely"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", "use reproduce display distribute execute and transmit the software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format for any purpose even commercially you must give appropriate credit provide a link to the license and indicate if changes were made", "you must give appropriate credit provide a link to the license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "dedicate any and all copyright interest in the software to the public domain"),
)
#: The least score of a notice.
LEAST = 0.5
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _slots() -> tuple[int, dict[str, int]]:
    """A number of slots and each licence word's own slot: its hash modulo that number, never 0."""
    words = sorted({w for _, text, _ in NOTICES for w in text.split()})
    hashes = {w: xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words}  # Spark's xxhash64
    signed = {w: h - 2**64 if h >= 2**63 else h for w, h in hashes.items()}
    n = 1024
    while len({h % n for h in signed.values()} - {0}) < len(words):
        n += 1
    return n, {w: h % n for w, h in signed.items()}


SLOTS, SLOT = _slots()


def _array(values, kind: str) -> str:
    """SQL of a constant array of numbers."""
    return f"cast(array({', '.join(map(str, values))}) as array<{kind}>)"


def numbered(words: Column) -> Column:
    """Each word's slot if it is a licence word, else 0."""
    at = {k: w for w, k in SLOT.items()}
    names = F.expr("array(" + ", ".join(f"'{at.get(i, '')}'" for i in range(SLOTS)) + ")")
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("short")
    return F.transform(words, lambda w: let(slot(w), lambda k: F.when(F.get(names, k.cast("int")) == w, k).otherwise(F.lit(0).cast("short"))))


def anchors(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, template, position) of the rarest words that a match cannot be without: the rest has less than LEAST of the template's IDF."""
    out = []
    for n, (_, text, _) in enumerate(NOTICES):
        ranked = sorted(((idf[w], w, p) for p, w in enumerate(text.split())), reverse=True)
        rest = total = sum(x for x, *_ in ranked)
        for x, w, p in ranked:
            if rest < LEAST * total:
                break
            out.append((w, n, p))
            rest -= x
    return out


#: Offsets in a packed candidate are shifted by this, as a template may begin before its file.
SHIFT = 1 << 12


def found(numbers: Column, idf: dict[str, float]) -> Column:
    """array<struct<label, offset, score>>, sorted, of the templates that stand in a text of licence-word numbers."""
    postings: list[list[int]] = [[] for _ in range(SLOTS)]
    for w, n, p in anchors(idf):
        postings[SLOT[w]].append(n * (1 << 40) + SHIFT - p)  # plus the position in the file: template and offset
    index = F.expr("array(" + ", ".join(_array(x, "bigint") for x in postings) + ")")
    texts = [text.split() for _, text, _ in NOTICES]
    fields = [(label, [SLOT[w] for w in t], [idf[w] / sum(idf[v] for v in t) for w in t], len(text[: text.index(key)].split()), len(key.split())) for (label, text, key), t in zip(NOTICES, texts, strict=True)]
    template = F.expr("array(" + ", ".join(f"named_struct('label', '{label}', 'slots', {_array(k, 'smallint')}, 'shares', {_array([f'{x!r}D' for x in v], 'double')}, 'key_at', {at}, 'key_n', {n})" for label, k, v, at, n in fields) + ")")
    anchored = F.flatten(F.transform(numbers, lambda k, i: F.transform(F.get(index, k.cast("int")), lambda x: x + i)))
    places = F.array_distinct(anchored)

    def one(c: Column) -> Column:
        offset = (c % (1 << 40) - SHIFT).cast("int")

        def judged(t: Column) -> Column:
            hit = F.transform(t["slots"], lambda k, i: F.when(offset + i >= 0, F.coalesce(F.get(numbers, offset + i) == k, F.lit(False))).otherwise(False))
            share = lambda h: F.aggregate(F.zip_with(h, t["shares"], lambda a, x: F.when(a, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
            return let(hit, lambda h: F.struct(t["label"].alias("label"), offset.alias("offset"), F.least(F.lit(1.0), share(h)).alias("score"), F.forall(F.slice(h, t["key_at"] + 1, t["key_n"]), lambda x: x).alias("key")))

        return let(F.get(template, F.floor(c / (1 << 40)).cast("int")), judged)

    held = F.filter(F.transform(places, one), lambda x: x["key"] & (x["score"] >= LEAST))
    return F.sort_array(F.transform(held, lambda x: F.struct(x["label"].alias("label"), x["offset"].alias("offset"), x["score"].alias("score"))))


def _places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(occurrences, first word or null, last word or null) of a phrase in a text whose words all have two blanks between them."""
    p = " " + phrase.replace(" ", "  ") + " "
    count = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(p), F.lit("")))) / len(p)).cast("long")
    first, last = F.instr(spaced, p), F.instr(F.reverse(spaced), p[::-1])
    blanks = lambda s: ((F.length(s) - F.length(without(s, " "))) / 2).cast("long")
    before = F.substring(spaced, F.lit(1), first - 1)
    before_last = F.substring(spaced, F.lit(1), F.length(spaced) - (last - 1) - len(p))
    return count, F.when(first > 0, blanks(before)), F.when(last > 0, blanks(before_last))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.
    base_labels and labels (base and index) are distinct, sorted and comma-joined
    ("" for none); score is 1 with a base label, else the best template's share,
    else 0; notices is an array of {label, offset in words, score}, null for
    none; an offset below 0 says that the template's head is missing. Null texts
    are empty and have no words. Ids may be null or repeat: equal rows have equal
    results. Other columns are ignored.
    """
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))  # of non-ASCII characters only U+212A gets an ASCII letter, k, by this
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.trim(F.regexp_replace(text, APART, " ")).alias("r"))
    n = F.when(F.col("r") == "", 0).otherwise(F.length("r") - F.length(without(F.col("r"), " ")) + 1).cast("long")
    spaced = F.concat(F.lit(" "), F.replace("r", F.lit(" "), F.lit("  ")), F.lit(" "))
    base = {}
    for p in BASE:
        count, first, last = _places(spaced, p)
        base[p] = F.when(F.contains("r", F.lit(p)), F.struct(count.alias("n"), first.alias("first"), last.alias("last")))
    none = F.expr("cast(array() as array<short>)")
    numbers = let(numbered(F.split("r", " ")), lambda x: F.when(F.exists(x, lambda k: k > 0), x).otherwise(none))
    rows = cut(rows.select("doc_id", n.alias("n_words"), numbers.alias("numbers"), *(c.alias(f"b{i}") for i, c in enumerate(base.values()))))

    total = rows.count()
    df = {r["k"]: r["n"] for r in rows.select(F.explode(F.array_distinct("numbers")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a licence word at most
    idf = {w: math.log((total + 1.0) / (df.get(k, 0) + 0.5)) for w, k in SLOT.items()}

    hits = [F.coalesce(F.col(f"b{i}.n"), F.lit(0).cast("long")) for i in range(len(BASE))]
    basic = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(h > 0, F.lit(label)) for h, label in zip(hits, BASE.values(), strict=True))))))
    rows = rows.select(
        "doc_id", "n_words", sum(hits[1:], hits[0]).alias("n_base"), F.least(*(F.col(f"b{i}.first") for i in range(len(BASE)))).alias("first_word"), F.greatest(*(F.col(f"b{i}.last") for i in range(len(BASE)))).alias("last_word"),
        basic.alias("basic"), found(F.col("numbers"), idf).alias("notices"),
    )
    own = F.transform("notices", lambda x: x["label"])
    top = F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("basic", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("basic", own))), ",").alias("labels"),
        F.when(F.size("basic") > 0, 1.0).otherwise(top).alias("score"), F.when(F.size("notices") > 0, F.col("notices")).alias("notices"),
    )
