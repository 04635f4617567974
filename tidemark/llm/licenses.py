"""Licence scan: text units against licence templates by the Dice coefficient of their word bigrams.

Units are lines, paragraphs of several lines and sentences. A line of comment signs alone ends a paragraph as a blank
one does. A unit that reaches the threshold shares two thirds of a template's
bigrams, so it holds one of a few of them, and its number of bigrams lies between two bounds; both tests are exact
and come before any set is built. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

# Wordings of common licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
BLANK = r"\n[ \t#*/;%!-]*\n"
STOP = r"[.!?][\"')\]]*[ \t\n]"


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams of a set that can reach ``threshold`` with one of n: 2 min / (n + m) >= threshold."""
    fits = [m for m in range(1, int(n * (2 / threshold - 1)) + 3) if 2 * min(n, m) >= threshold * (n + m) - 1e-9]
    return fits[0], fits[-1]


def signs(grams: list[str], threshold: float) -> list[tuple[str, str]]:
    """Bigrams one of which any unit that reaches the threshold holds.

    It shares at least threshold / (2 - threshold) of the template's bigrams, so one bigram more than may be missing
    will do. The longest are taken, being the rarest.
    """
    spare = int(len(grams) - threshold / (2 - threshold) * len(grams) + 1e-9)
    return [tuple(g.split()) for g in sorted(grams, key=lambda g: (-len(g), g))[: spare + 1]]


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each unit that is like a template: doc_id, unit ("line", "paragraph" or "sentence"), position (from 0), license, dice.

    Words are lower-cased runs of a-z and 0-9; a unit's bigrams are a set, units of one word have none and match
    nothing. Of several templates the one of highest coefficient is reported, ties to the name that sorts first. Null
    and empty texts have no rows, null ids stay null, repeated rows repeat theirs, an empty table gives none. Whole
    texts are scanned and other columns are not read. A text without a blank line has no paragraphs but its lines, one
    without a stop followed by white space no sentences.
    """
    grams = {k: g for k, t in sorted((templates or TEMPLATES).items()) if (g := bigrams(normal_words(t)))}
    both = sorted({x for g in grams.values() for x in signs(g, threshold)})

    def signed(c: Column) -> Column:
        """Both words of a sign are in the text; through an array, so that ``c`` is computed once."""
        return F.exists(F.array(c), lambda t: _any([t.contains(a) & t.contains(b) for a, b in both]))

    limits = {k: bounds(len(g), threshold) for k, g in grams.items()}
    least, most = min(a for a, _ in limits.values()), max(b for _, b in limits.values())
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("t")).where(signed(F.col("t")))

    def cut(pattern: str, unit: str) -> Column:
        return F.transform(F.split("t", pattern), lambda u, i: F.struct(F.lit(unit).alias("unit"), i.cast("long").alias("position"), u.alias("u")))

    parts = F.filter(cut(BLANK, "paragraph"), lambda x: x["u"].contains("\n"))
    sentences = cut(STOP, "sentence")
    either = [F.when(F.col("t").rlike(pattern), found).otherwise(F.slice(found, 1, 0)) for pattern, found in ((BLANK, parts), (STOP, sentences))]
    units = d.select("doc_id", F.explode(F.concat(cut("\n", "line"), *either)).alias("x")).select("doc_id", "x.unit", "x.position", "x.u").where(signed(F.col("u")))
    units = units.withColumn("w", F.filter(F.split("u", "[^a-z0-9]+"), lambda x: x != "")).where(F.size("w") > least)
    following = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.array_distinct(F.filter(F.zip_with("w", following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull()))
    units = units.select("doc_id", "unit", "position", pairs.alias("g")).where(F.size("g").between(least, most))
    n = F.size("g")
    dice = [F.when(n.between(*limits[k]), F.struct((F.lit(2.0) * F.size(F.array_intersect("g", F.array(*map(F.lit, g)))) / (n + len(g))).alias("dice"), F.lit(k).alias("license"))) for k, g in grams.items()]
    found = F.filter(F.array(*dice), lambda x: x.isNotNull() & (x["dice"] >= threshold))
    best = F.reduce("found", F.element_at("found", 1), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))
    return units.withColumn("found", found).where(F.size("found") > 0).withColumn("best", best).select("doc_id", "unit", "position", "best.license", F.round("best.dice", 6).alias("dice"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of ``documents``; odd rows as in ``scan``."""
    return scan(read(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL, every unit against every template of a size that can reach the threshold."""
    blank, stop = (x.replace("'", "''") for x in (BLANK, STOP))
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted((templates or TEMPLATES).items()))
    grams = "list_distinct([{w}[i] || ' ' || {w}[i + 1] for i in range(1, len({w}))])"
    words = "list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH raw AS (SELECT license, {words.format(t='body')} AS w FROM (VALUES {rows}) v(license, body)),
tpl AS (SELECT license, {grams.format(w='w')} AS g FROM raw),
cut AS (
  SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS parts FROM documents
  UNION ALL SELECT doc_id, 'paragraph', string_split_regex(text, '{blank}') FROM documents WHERE regexp_matches(text, '{blank}')
  UNION ALL SELECT doc_id, 'sentence', string_split_regex(text, '{stop}') FROM documents WHERE regexp_matches(text, '{stop}')
), each AS (SELECT doc_id, unit, unnest(parts) AS u, unnest(range(len(parts))) AS position FROM cut),
cand AS (SELECT doc_id, unit, position, {words.format(t='u')} AS w FROM each WHERE unit <> 'paragraph' OR contains(u, chr(10))),
un AS (SELECT doc_id, unit, position, {grams.format(w='w')} AS g FROM cand WHERE len(w) > 1),
s AS (
  SELECT doc_id, unit, position, license, 2.0 * len(list_intersect(un.g, tpl.g)) / (len(un.g) + len(tpl.g)) AS dice
  FROM un JOIN tpl ON len(un.g) BETWEEN len(tpl.g) * {threshold} / (2 - {threshold}) - 1e-6 AND len(tpl.g) * (2 - {threshold}) / {threshold} + 1e-6
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, license) AS k FROM s WHERE dice >= {threshold})
SELECT doc_id, unit, CAST(position AS BIGINT) AS position, license, round(CAST(dice AS DOUBLE), 6) AS dice FROM r WHERE k = 1
"""


OP9_SQL = oracle()
