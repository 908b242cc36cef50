"""License scans: Dice coefficient over word bigrams against licence templates, in
Spark's own operators only.

The units compared are every line, every paragraph (lines up to an empty one) of
two lines or more, and the whole text if it has two paragraphs or more; where lines
hold a comment mark alone, the paragraphs that those part are units too.  A notice
inside a longer line or paragraph is found by windows: each template has up to ANCHORS
bigrams, the longest of as many equal parts, and wherever a text holds one of them, as
many words as the template has, placed so that the two bigrams meet, are a unit of that
template.  Texts are lower-cased and everything but letters and digits parts words.  Bigrams count as a
bag: with a and b bigrams the coefficient is 2 * common / (a + b), so it can reach
t only if t / (2 - t) * b <= a <= (2 - t) / t * b.  A unit's size, the number of
its bigrams, is joined with the sizes that each template admits; only those pairs
are compared.  A match lacks at most (2 - 2t) / (2 - t) of a template's bigrams, so of
any larger part of them a unit holds at least one: that part, the template's longest
bigrams, is its telling part, and texts, then units, then pairs without a bigram of
it are left out before anything is counted.  Of a unit's matches the closest licence alone counts, so a GPL-2 header
is not a GPL-3 one too; two licences closer than MARGIN leave the unit undecided unless
one matches it word for word.  The table of sizes depends on the templates alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import common

THRESHOLD = 0.8
MARGIN = 0.005
ANCHORS = 5

#: The two conditions and the disclaimer that BSD texts share.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
    " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution."
)
_BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_TAIL = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
    " PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT"
    " OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON"
    " ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence notices and grants, as their authors word them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"
        " (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD-2-Clause": [_BSD_HEAD, _BSD_HEAD + _BSD_TAIL],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_THIRD, _BSD_HEAD + _BSD_THIRD + _BSD_TAIL],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}


def template_bigrams(text: str) -> list[str]:
    """Word bigrams of a template in order (the rule that :func:`_words` applies)."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bigrams(text: str) -> Counter:
    return Counter(template_bigrams(text))


def _longer(mark: str) -> str:
    return max(mark.split(" "), key=len)


def anchors(text: str) -> list[tuple[int, str]]:
    """(position, bigram) of a template's anchors: the longest bigram of each part."""
    own = template_bigrams(text)
    parts = min(ANCHORS, len(own))
    cuts = [len(own) * k // parts for k in range(parts + 1)]
    best = [max(range(lo, hi), key=lambda j: (len(own[j]), -j)) for lo, hi in zip(cuts, cuts[1:])]
    return [(j, own[j]) for j in best]


def telling(text: str, threshold: float) -> list[str]:
    """The longest bigrams of a template, one more (with repeats) than a unit that
    reaches ``threshold`` may lack: such a unit holds at least one of them."""
    bag = bigrams(text)
    size = sum(bag.values())
    spare = math.floor(size * (2 - 2 * threshold) / (2 - threshold) + 1e-9)
    out, held = [], 0
    for mark in sorted(bag, key=lambda b: (-len(_longer(b)), -len(b), b)):
        if held > spare:
            break
        out.append(mark)
        held += bag[mark]
    return out


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def template_tables(
    spark: SparkSession, templates: dict[str, list[str]], threshold: float
) -> tuple[DataFrame, DataFrame]:
    """(template_id, license, bigrams, counts, size, telling) and (template_id,
    unit_size): every unit size that can reach ``threshold`` with the template."""
    texts = [(name, bigrams(text), telling(text, threshold)) for name, own in templates.items() for text in own]
    structs = [
        F.struct(
            F.lit(k).alias("template_id"),
            F.lit(name).alias("license"),
            F.array(*map(F.lit, bag)).alias("bigrams"),
            F.array(*map(F.lit, bag.values())).alias("counts"),
            F.lit(sum(bag.values())).alias("size"),
            F.array(*map(F.lit, marks)).alias("telling"),
        )
        for k, (name, bag, marks) in enumerate(texts)
    ]
    table = spark.range(1).select(F.inline(F.array(*structs)))
    least = F.ceil(F.lit(threshold / (2 - threshold)) * F.col("size") - 1e-9)
    most = F.floor(F.lit((2 - threshold) / threshold) * F.col("size") + 1e-9)
    sizes = table.select(
        "template_id", F.explode(F.sequence(F.greatest(least, F.lit(1)), most).cast("array<int>")).alias("unit_size")
    )
    return table, sizes


def _bigrams(w: str) -> Column:
    """The bigrams of an array of two words or more; not nullable, or the planner
    would test it for null on every unit."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(F.col(w), i), F.get(F.col(w), i + 1))
    )
    return F.coalesce(each, F.array().cast("array<string>"))


def _hinted(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Of ``rows`` with their words as ``w`` those that hold one of the bigrams
    ``marks``, with all bigrams as ``own``.  The longer words of ``marks`` are looked
    for first, as no bigram need be built for that.

    explode(array(x)) works x out once a row; inlined, it would be worked out again
    wherever it is used."""
    words = F.array(*map(F.lit, sorted({_longer(mark) for mark in marks})))
    rows = rows.filter((F.size("w") >= 2) & F.arrays_overlap("w", words))
    rows = rows.select("*", F.explode(F.array(_bigrams("w"))).alias("own"))
    return rows.filter(F.arrays_overlap("own", F.array(*map(F.lit, marks))))


def hinted_documents(docs: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(did, th, text, w) of the documents that hold a telling bigram of any template;
    no other document can hold a matching unit, as units part texts between words."""
    marks = sorted({mark for own in templates.values() for text in own for mark in telling(text, threshold)})
    rows = common.keyed(docs).select("did", "th", "text")
    rows = rows.select("*", F.explode(F.array(F.split(_words(F.col("text")), " "))).alias("w"))
    return _hinted(rows, marks).drop("own")


def license_units(rows: DataFrame) -> DataFrame:
    """(did, th, unit, words): the lines, paragraphs and whole texts of
    :func:`hinted_documents` to compare."""
    rows = rows.select("did", "th", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    lines = F.split("text", "\n")
    parts = F.split("text", r"\n[ \t]*\n\s*")
    longer = F.filter(parts, lambda p: F.contains(F.trim(p), F.lit("\n")))
    bare = r"\n[ \t]*(?:[#*;%]+|//+|--+)[ \t]*(?=\n)"  # a comment's empty line
    inner = F.split(F.regexp_replace("text", bare, "\n"), r"\n[ \t]*\n\s*")
    inner = F.filter(inner, lambda p: F.contains(F.trim(p), F.lit("\n")) & ~F.array_contains(parts, p))
    inner = F.when(F.col("text").rlike(bare), inner).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size(parts) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    kinds = [("line", lines), ("paragraph", longer), ("paragraph", inner), ("text", whole)]

    def of_kind(kind: str):  # a second parameter would be the element's index
        return lambda x: F.struct(F.lit(kind).alias("unit"), x.alias("text"))

    units = F.concat(*(F.transform(c, of_kind(kind)) for kind, c in kinds))
    return (
        rows.select("did", "th", F.explode(units).alias("u"))
        .select("did", "th", "u.unit", _words(F.col("u.text")).alias("words"))
        .filter(F.contains("words", F.lit(" ")))
    )


def _windows(rows: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """(did, th, unit, at, template_id, w): the windows at the anchors of templates.

    Texts without the longer word of any anchor are left out first. A window at an end of the text is moved into it."""
    texts = [text for own in templates.values() for text in own]
    marks = [(k, j, mark, len(template_bigrams(t))) for k, t in enumerate(texts) for j, mark in anchors(t)]
    leads = sorted({_longer(mark) for _, _, mark, _ in marks})
    known = F.array(
        *(
            F.struct(
                F.lit(k).alias("template_id"),
                F.lit(_longer(mark)).alias("word"),
                F.lit(mark).alias("mark"),
                F.lit(j).alias("j"),
                F.lit(j + mark.split(" ").index(_longer(mark))).alias("lead"),
                F.lit(size).alias("size"),
            )
            for k, j, mark, size in marks
        )
    )
    words = F.array(*map(F.lit, leads))
    rows = rows.select("did", "th", "w").filter(F.arrays_overlap("w", words))
    spots = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_contains(words, s["x"]))
    rows = rows.select("did", "th", "w", F.explode(F.array(spots)).alias("spots"))

    def fits(s: Column, a: Column) -> Column:
        first = s["i"] - a["lead"] + a["j"]
        bigram = F.concat_ws(" ", F.get(F.col("w"), first), F.get(F.col("w"), first + 1))
        return (s["x"] == a["word"]) & (bigram == a["mark"])

    def placed(s: Column, a: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(s["i"] - a["lead"], F.size("w") - a["size"] - 1))
        return F.struct(a["template_id"].alias("template_id"), start.alias("at"), a["size"].alias("size"))

    found = F.flatten(F.transform("spots", lambda s: F.transform(F.filter(known, lambda a: fits(s, a)), lambda a: placed(s, a))))
    rows = rows.select("did", "th", "w", F.explode(F.array(F.array_distinct(found))).alias("found"))
    cut = F.transform(
        "found",
        lambda v: F.struct(
            v["template_id"].alias("template_id"), v["at"].alias("at"), F.slice(F.col("w"), v["at"] + 1, v["size"] + 1).alias("w")
        ),
    )
    return rows.select("did", "th", F.explode(cut).alias("v")).select(
        "did", "th", F.lit("window").alias("unit"), F.col("v.at").cast("string").alias("at"), "v.template_id", "v.w"
    )


def license_matches(
    docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES
) -> DataFrame:
    """Units that reach ``threshold`` with a template, of the closest licence of each
    unit: did, th, unit, template_id, license, dice, size (the template's bigrams)."""
    table, sizes = template_tables(docs.sparkSession, templates, threshold)
    marks = sorted({mark for own in templates.values() for text in own for mark in telling(text, threshold)})
    # Written, as units and windows both read them: few texts hold a licence.
    rows = common.materialize(hinted_documents(docs, templates, threshold), "hinted")
    units = license_units(rows).withColumns({"w": F.split("words", " "), "at": F.xxhash64("words").cast("string")})
    units = _hinted(units, marks).withColumn("unit_size", F.size("w") - 1)
    columns = ["did", "th", "unit", "at", "unit_size", "template_id", "own"]
    pairs = units.join(F.broadcast(sizes), "unit_size").select(*columns)
    placed = _hinted(_windows(rows, templates), marks).withColumn("unit_size", F.size("w") - 1)
    pairs = pairs.unionByName(placed.select(*columns))
    pairs = pairs.join(F.broadcast(table), "template_id").filter(F.arrays_overlap("own", "telling"))
    # The distinct bigrams in common, and all repeats that the template has, bound the
    # coefficient from above; the count by pairs is left to those that can reach it.
    most = F.size(F.array_intersect("own", "bigrams")) + F.col("size") - F.size("bigrams")
    pairs = pairs.filter(2 * most >= F.lit(threshold) * (F.col("unit_size") + F.col("size")) - 1e-9)
    each = F.zip_with("bigrams", "counts", lambda b, c: F.least(c, F.size(F.filter("own", lambda x: x == b))))
    common_n = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    near = pairs.withColumn("dice", 2 * common_n / (F.col("unit_size") + F.col("size"))).filter(F.col("dice") >= threshold)
    unit = Window.partitionBy("did", "th", "unit", "at")
    closest = F.max(F.struct("dice", "size", "license")).over(unit)
    other = F.max(F.when(F.col("license") != F.col("top.license"), F.col("dice"))).over(unit)
    sure = (F.col("top.dice") == 1) | F.col("other").isNull() | (F.col("top.dice") - F.col("other") >= MARGIN)
    return (
        near.withColumn("top", closest)
        .withColumn("other", other)
        .filter((F.col("license") == F.col("top.license")) & sure)
        .select("did", "th", "unit", "template_id", "license", "dice", "size")
    )


def scan_licenses(
    docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES
) -> DataFrame:
    """One row per document: doc_id, license and dice of its best match (ties: the
    longer template, then the first name in order), n_matches (matching pairs of unit
    and template) and licenses (all names found in any unit, in order: a kin of the
    best one whose window starts elsewhere is listed too); nulls, 0 and an empty list
    without one.

    A null or empty text matches nothing; rows that repeat doc_id and text share
    their matches' numbers; an empty table gives no rows; other columns are not
    read.
    """
    best = F.struct((-F.col("top.dice")).alias("d"), (-F.col("top.size")).alias("s"), F.col("license").alias("name"))
    found = (
        license_matches(docs, threshold, templates)
        .groupBy("did", "th", "license")
        .agg(F.max(F.struct("dice", "size")).alias("top"), F.count(F.lit(1)).alias("n"))
        .groupBy("did", "th")
        .agg(
            F.min(best).alias("best"),
            F.sum("n").alias("n_matches"),
            F.sort_array(F.collect_set("license")).alias("licenses"),
        )
    )
    ids = common.keyed(docs).select("doc_id", "did", "th")
    return ids.join(found, ["did", "th"], "left").select(
        "doc_id",
        F.col("best.name").alias("license"),
        (-F.col("best.d")).alias("dice"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: licence notices in all documents."""
    return scan_licenses(common.documents(spark, sf_dir))
