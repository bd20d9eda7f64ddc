"""Licence scan with built-in functions only.

A document's segments (its lines, its paragraphs of several lines, the whole
text if it has several lines) are normalised to ASCII words and compared with
every licence template by the Dice coefficient of their word-bigram sets.
Dice >= t needs n * t <= m * (2 - t) and m * t <= n * (2 - t) for set sizes m
and n, so most templates, and segments out of every template's range, are
pruned by size before any sets are intersected.  All work is inside the row:
no shuffle, no explode.

A notice that shares its line or paragraph is found as a run of words of the whole
text, in a template's size range.  A run that matches holds two thirds of the
template's bigrams, so it holds one of any third of them and one more (anchors);
only texts with an anchor are searched.  The best run starts and ends with a bigram
of the template.  Of overlapping runs of several templates the one
with most in common counts.

Cases: null or empty text has no segment and no licence; a segment of one word
has no bigram; ties go to the first template by name; repeated rows give
repeated results; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspace.llm.runtime import narrow

# Licence notices and short licences, as published.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.",
                "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.")
_BSD_THIRD = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission.")
_GNU = ("{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public "
        "License as published by the Free Software Foundation; either version {2} of the License, or (at your option) "
        "any later version.")
_WHOLE_GNU = "GNU {0}GENERAL PUBLIC LICENSE Version {1}, {2} Copyright (C) {3} Free Software Foundation, Inc."
# Further notices and the parts by which whole licence texts are known; searched as runs only.
NOTICES = {
    "Apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR "
                   "USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [_BSD + _BSD_THIRD],
    "GPL-2.0": [_GNU.format("This program", "", 2), _WHOLE_GNU.format("", 2, "June 1991", "1989, 1991")],
    "GPL-3.0": [_GNU.format("This program", "", 3), _WHOLE_GNU.format("", 3, "29 June 2007", "2007")],
    "LGPL-3.0": [_GNU.format("This library", "Lesser ", 3), _WHOLE_GNU.format("LESSER ", 3, "29 June 2007", "2007")],
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."],
}
THRESHOLD = 80  # Dice in hundredths

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def compiled(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return sorted((name, bigrams_of(t)) for name, texts in templates.items() for t in texts)


def anchors_of(bigrams: list[str]) -> list[str]:
    """A third of the bigrams and one more, long words first."""
    return sorted(bigrams, key=lambda b: (-min(map(len, b.split())), b))[:len(bigrams) // 3 + 1]


def in_range(m: Column, n: int, threshold: int) -> Column:
    """Sizes that can reach the threshold."""
    return (m * threshold <= n * (200 - threshold)) & (m * (200 - threshold) >= n * threshold)


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def runs(words: Column, table: list[tuple[str, list[str]]], threshold: int) -> Column:
    """The templates' best runs in a text's words (null: no anchor in it)."""
    anchors = sorted({x for _, b in table for x in anchors_of(b)})

    def of_template(grams: Column, held: Column, k: int) -> Column:
        name, tb = table[k]
        least = -(-len(tb) * threshold // (200 - threshold))     # bigrams in common, and in a run
        most = len(tb) * (200 - threshold) // threshold

        def run(start: Column, end: Column) -> Column:
            return let(F.array_distinct(F.slice(grams, start + 1, end - start + 1)), lambda b: let(
                F.size(F.array_intersect(b, F.array(*map(F.lit, tb)))), lambda common: F.struct(
                    (common * 2 / (F.size(b) + len(tb))).alias("dice"), common.alias("common"), F.lit(-k).alias("rank"),
                    F.lit(name).alias("name"), start.alias("from"), end.alias("to"))))

        def search(at: Column) -> Column:
            found = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), lambda i: let(
                F.get(at, i), lambda start: F.transform(
                    F.filter(F.slice(at, i + least, most), lambda end: end - start < most),
                    lambda end: run(start, end)))))
            return F.when(F.size(at) >= least, F.array_max(F.filter(found, lambda x: x["dice"] * 100 >= threshold)))

        return F.when(F.arrays_overlap(held, F.array(*map(F.lit, anchors_of(tb)))), let(
            F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.get(grams, i).isin(tb)), search))

    def best(grams: Column) -> Column:
        held = F.filter(grams, lambda g: g.isin(anchors))
        return let(held, lambda h: F.when(F.size(h) > 0, let(
            F.filter(F.array(*[of_template(grams, h, k) for k in range(len(table))]), lambda x: x.isNotNull()),
            lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (
                (y["from"] <= x["to"]) & (x["from"] <= y["to"])
                & (F.struct(y["common"], y["dice"], y["rank"]) > F.struct(x["common"], x["dice"], x["rank"]))))))))

    return F.when(F.size(words) > 1, let(F.transform(
        F.sequence(F.lit(0), F.size(words) - 2),
        lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))), best))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: int = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_segments, n_hits (segments that match a licence as a whole), license
    (best match of segments and runs, null if none), score (its Dice) and licenses
    (all, sorted)."""
    table = compiled(templates or TEMPLATES)
    wide = table if templates else compiled({n: t + NOTICES.get(n, []) for n, t in TEMPLATES.items()})
    sizes = [len(b) for _, b in table]
    low = min(sizes) * threshold // (200 - threshold)
    known = F.array(*[F.lit(x) for x in sorted({x for _, b in table for x in b})])
    text = F.translate("text", UPPER, LOWER)
    segments = narrow(docs, id_col, text_col).select("doc_id", text.alias("t"), F.filter(F.concat(
        F.split(text, "\n"),
        F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: p.contains("\n")),
        F.when(text.contains("\n"), F.array(text)).otherwise(F.array().cast("array<string>"))),
        lambda s: s != "").alias("segs"))
    worded = segments.select("doc_id", "t", F.size("segs").cast("long").alias("n_segments"), F.transform(
        "segs", lambda s: F.array_remove(F.split(s, "[^a-z0-9]+"), "")).alias("ws"))
    # Distinct bigrams are at most words - 1, which prunes short segments; long
    # ones are pruned when their distinct bigrams are known.
    grams = worded.select("doc_id", "t", "n_segments", F.filter(F.transform(
        F.filter("ws", lambda w: F.size(w) > max(low, 1)),
        lambda w: F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size(w) - 2),
            lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))),
        lambda b: (F.size(b) * threshold <= max(sizes) * (200 - threshold)) & F.arrays_overlap(b, known)).alias("bs"))

    def best(b: Column) -> Column:
        """Greatest (Dice, first name) over the templates in range."""
        found = [F.when(in_range(F.size(b), len(tb), threshold), F.struct(
            (F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in tb]))) * 2 / (F.size(b) + len(tb))).alias("dice"),
            F.lit(-k).alias("rank"), F.lit(name).alias("name"))) for k, (name, tb) in enumerate(table)]
        return F.array_max(F.filter(F.array(*found), lambda x: x["dice"] * 100 >= threshold))

    hits = grams.select("doc_id", "n_segments",
                        F.filter(F.transform("bs", best), lambda x: x.isNotNull()).alias("hits"),
                        let(F.array_remove(F.split("t", "[^a-z0-9]+"), ""), lambda w: runs(w, wide, threshold)).alias("runs"))
    # Ranks of the two tables differ: ties go to the first name either way.
    ranked = hits.select("doc_id", "n_segments", F.size("hits").cast("long").alias("n_hits"), F.concat(*[
        F.transform(c, lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))
        for c in (F.col("hits"), F.when(F.col("runs").isNotNull(), F.col("runs")).otherwise(F.array().cast(
            "array<struct<dice:double,common:int,rank:int,name:string,from:int,to:int>>")))]).alias("found"))
    top = F.array_max(F.transform("found", lambda x: x["dice"]))
    return ranked.select(
        "doc_id", "n_segments", "n_hits",
        F.array_min(F.transform(F.filter("found", lambda x: x["dice"] == top), lambda x: x["name"])).alias("license"),
        F.round(top, 6).alias("score"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["name"]))), ",").alias("licenses"))
