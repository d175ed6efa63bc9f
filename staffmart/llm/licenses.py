"""Licence notices by the Dice coefficient of word bigrams.

A unit is a line, a paragraph (several lines between blank lines), or a whole text of several paragraphs. Its words are
runs of letters and digits, lower-cased; its set holds all distinct word bigrams. A unit carries a licence if 2 * shared /
(unit bigrams + template bigrams) >= 0.8. That bounds the unit's size against the template's, and units outside
the bounds of every template are not compared. It also bounds the shared bigrams from below: every
template has a few anchor words that so many of its bigrams contain that no unit without one of them can match, and only
texts with an anchor are cut into units. All of it is DataFrame functions.

Defined results: NULL and empty texts, and units of fewer than two words, carry nothing; of several licences the likeliest counts, then
the first by name and template; rows with equal ids are one document.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = Fraction(4, 5)

# Notices by which texts state their licence, in the words of the licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}


def template_bigrams() -> list[tuple[str, int, list[str]]]:
    """(licence, template number, bigrams) of every template."""
    found = []
    for licence, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", text.lower())
            found.append((licence, number, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return found


def least_shared(size: int) -> int:
    """Fewest bigrams a unit shares with a template of ``size``, as the unit has at least as many as it shares."""
    bound = DICE * size / (2 - DICE)
    return -(-bound.numerator // bound.denominator)


def anchors() -> list[str]:
    """Words such that every unit matching any template has one of them."""
    chosen: list[str] = []
    for _, _, bigrams in template_bigrams():
        left = [b for b in bigrams if not set(b.split()) & set(chosen)]
        while len(left) >= least_shared(len(bigrams)):
            words = {w for b in left for w in b.split() if len(w) > 1}
            best = max(sorted(words), key=lambda w: (sum(w in b.split() for b in left) * min(len(w), 6), w))
            chosen.append(best)
            left = [b for b in left if best not in b.split()]
    return chosen


def bigrams(unit: Column) -> Column:
    """The distinct word bigrams of a unit."""
    words = F.array_remove(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), "")
    pairs = lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1))
    )
    return F.array_distinct(F.flatten(F.transform(F.array(words), pairs)))


def units(docs: DataFrame) -> DataFrame:
    """(id, unit, unit_no, content) of texts (id, text)."""
    lines = docs.select("id", F.lit("line").alias("unit"), F.posexplode_outer(F.split("text", "\n")).alias("unit_no", "content"))
    paragraphs = F.split("text", r"\n\s*\n")
    blocks = docs.select("id", F.lit("paragraph").alias("unit"), F.posexplode_outer(paragraphs).alias("unit_no", "content"))
    whole = docs.where(F.size(paragraphs) > 1).select("id", F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("text").alias("content"))
    return lines.unionByName(blocks.where(F.contains("content", F.lit("\n")))).unionByName(whole)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, unit_no, license, template, n_shared, n_unit, n_template): the likeliest licence of every unit that carries one."""
    spark = docs.sparkSession
    # The templates of the fixed list above, by each unit size that their bounds admit.
    rows = [
        (size, licence, number, pairs, len(pairs))
        for licence, number, pairs in template_bigrams()
        for size in range(least_shared(len(pairs)), int(len(pairs) * (2 - DICE) / DICE) + 1)
    ]
    schema = "n_unit int, license string, template int, pairs array<string>, n_template int"
    templates = F.broadcast(spark.createDataFrame(rows, schema))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    low, any_anchor = F.lower("text"), F.lit(False)
    for word in anchors():
        any_anchor = any_anchor | F.contains(low, F.lit(word))
    found = units(docs.where(any_anchor)).select("id", "unit", "unit_no", bigrams(F.col("content")).alias("own"))
    # A size that is never NULL: the join would test a nullable one for NULL, and cut every unit into bigrams twice.
    found = found.withColumn("n_unit", F.coalesce(F.size("own"), F.lit(0)))
    near = found.join(templates, "n_unit").withColumn("n_shared", F.size(F.array_intersect("own", "pairs")))
    near = near.where(2 * DICE.denominator * F.col("n_shared") >= DICE.numerator * (F.col("n_unit") + F.col("n_template")))
    likeness = -F.col("n_shared") / (F.col("n_unit") + F.col("n_template"))
    best = F.min(F.struct(likeness.alias("unlike"), "license", "template", "n_shared", "n_unit", "n_template"))
    return near.groupBy("id", "unit", "unit_no").agg(best.alias("best")).select("id", "unit", "unit_no", "best.*").drop("unlike")


def oracle() -> str:
    values = ", ".join(f"('{licence}', {number}, [{', '.join(repr(p) for p in pairs)}])" for licence, number, pairs in template_bigrams())
    return rf"""
WITH templates AS (SELECT license, template, pairs, len(pairs) AS n_template FROM (VALUES {values}) t(license, template, pairs)),
parts AS (
  SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS p FROM documents UNION ALL
  SELECT doc_id, 'paragraph', string_split_regex(text, '\n\s*\n') FROM documents UNION ALL
  SELECT doc_id, 'text', [text] FROM documents WHERE len(string_split_regex(text, '\n\s*\n')) > 1
), units AS (
  SELECT doc_id, unit, unnest(range(len(p))) AS unit_no, unnest(p) AS content FROM parts
), words AS (
  SELECT doc_id, unit, unit_no, list_filter(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM units
  WHERE unit <> 'paragraph' OR contains(content, chr(10))
), own AS (
  SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM words
)
SELECT doc_id, unit, unit_no::INT AS unit_no, license, template, len(list_intersect(own, pairs))::INT AS n_shared,
  len(own)::INT AS n_unit, n_template::INT AS n_template
FROM own JOIN templates ON 10 * len(list_intersect(own, pairs)) >= 4 * (len(own) + n_template)
QUALIFY row_number() OVER (
  PARTITION BY doc_id, unit, unit_no
  ORDER BY len(list_intersect(own, pairs)) / (len(own) + n_template) DESC, license, template) = 1
"""
