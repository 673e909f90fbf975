"""License scans: passages compared with licence templates by the Dice coefficient of their word bigrams.

Passages are the lines of a text and its paragraphs of several lines.  Both sides are reduced to
lower-case ASCII words.  Two sets of a and b bigrams reach the coefficient t only if a lies between
b * t / (2 - t) and b * (2 - t) / t, which rules out most templates by size alone; the others meet
through shared bigrams, so no passage is compared with a template it has nothing in common with.
They must also share b * t / (2 - t) bigrams at least, so of any set of one more bigrams than may be
missing one must be there: a document without a single word of those sets is not cut up at all.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table, spread

THRESHOLD = 0.8

#: Notices and texts of public licences. Callers may pass a table of their own.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
#: words that tell least; they are chosen last
_COMMON = {"a", "and", "any", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "under", "with"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case ASCII words; whatever else stands between them is ignored."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(found: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    many = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, F.lit(1), many), F.slice(found, F.lit(2), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def default_templates(spark: SparkSession) -> DataFrame:
    """(license, text) of TEMPLATES."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in TEMPLATES])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.license", "t.text")


def _telling(word: str) -> tuple:
    return word not in _COMMON, len(word)


def telling_words(templates: list, threshold: float) -> list:
    """Words of which every text that reaches ``threshold`` with one of the templates' bigram lists holds one at least."""
    found: set = set()
    for own in templates:
        missing = len(own) - math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
        longest = sorted((max(pair.split(" "), key=_telling) for pair in own), key=_telling, reverse=True)
        found.update(longest[: missing + 1])
    # a word that contains another one of the set is covered by it
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, place, passage): lines, and paragraphs of more than one line, by their number."""
    rows = spread(docs.select("doc_id", "text").filter("text IS NOT NULL"), "doc_id")
    lines = rows.select("doc_id", F.lit("line").alias("unit"), F.posexplode(F.split("text", "\n")).alias("place", "passage"))
    paragraphs = rows.filter(F.col("text").contains("\n")).select(
        "doc_id", F.lit("paragraph").alias("unit"), F.posexplode(F.split("text", "\n[ \t]*\n")).alias("place", "passage")
    ).filter(F.trim("passage").contains("\n"))
    return lines.unionByName(paragraphs)


def scan(docs: DataFrame, templates: DataFrame = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, place, license, dice): the best template of every passage that reaches ``threshold``.

    The templates are a list of bounded size (18 unless the caller gives others) and travel to every
    task. Of equally good licences the first by name counts. Null and empty texts have no passages.
    Rows that agree in id, place and passage are reported once; further columns are ignored.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    known = templates.select("license", F.monotonically_increasing_id().alias("template"), bigrams(words(F.col("text"))).alias("own"))
    known = known.withColumn("b", F.size("own")).filter("b > 0")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lists = [row["own"] for row in known.select("own").collect()]
    span = (min(map(len, lists)), max(map(len, lists))) if lists else (1, 0)
    telling = telling_words(lists, threshold)
    # one lower-case text for all tests
    held = F.exists(F.array(F.lower("text")), lambda t: reduce(lambda a, w: a | F.contains(t, F.lit(w)), telling, F.lit(False)))
    docs = docs.select("doc_id", "text").filter(held)
    entries = known.select("license", "template", "b", F.explode("own").alias("bigram"))
    found = passages(docs).withColumn("w", words(F.col("passage")))
    # size bounds first: a passage too short or too long for every template is not cut into bigrams
    found = found.filter(F.size("w") - 1 >= span[0] * low).withColumn("own", bigrams(F.col("w")))
    found = found.withColumn("a", F.size("own")).filter(F.col("a").between(span[0] * low, span[1] * high))
    each = found.select("doc_id", "unit", "place", F.xxhash64("passage").alias("passage"), "a", F.explode("own").alias("bigram"))
    near = F.col("a").between(F.col("b") * low, F.col("b") * high)
    shared = (
        each.join(F.broadcast(entries), "bigram").filter(near)
        .groupBy("doc_id", "unit", "place", "passage", "a", "template", "license", "b")
        .agg(F.size(F.collect_set("bigram")).alias("shared"))
        .withColumn("dice", F.col("shared") * 2 / (F.col("a") + F.col("b"))).filter(F.col("dice") >= threshold)
    )
    best = shared.groupBy("doc_id", "unit", "place", "passage").agg(
        F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best")
    )
    return best.select("doc_id", "unit", F.col("place").cast("long").alias("place"), "best.license", (-F.col("best.less")).alias("dice"))


def op10_licenses(spark, sf_dir):
    """Licence passages of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_words(text: str) -> str:
    return f"string_split(trim(regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
ORACLE = f"""
WITH templates AS (
  SELECT template, license, list_distinct(list_zip(w, w[2:], true)) AS own
  FROM (SELECT template, license, {_sql_words('t')} AS w FROM (VALUES {_VALUES}) v(template, license, t))
), parts AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS place,
         unnest(string_split(text, chr(10))) AS passage FROM documents
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(range(len(string_split_regex(text, '\\n[ \\t]*\\n')))) AS place,
           unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS passage FROM documents WHERE contains(text, chr(10))
  ) WHERE contains(trim(passage, ' '), chr(10))
), cut AS MATERIALIZED (
  SELECT DISTINCT doc_id, unit, place, passage, {_sql_words('passage')} AS w FROM parts
), sets AS (
  SELECT doc_id, unit, place, passage, list_distinct(list_zip(w, w[2:], true)) AS own FROM cut
), each AS (
  SELECT doc_id, unit, place, passage, len(own) AS a, unnest(own) AS bigram FROM sets
), entries AS (
  SELECT template, license, len(own) AS b, unnest(own) AS bigram FROM templates
), shared AS (
  SELECT doc_id, unit, place, passage, license, 2.0::DOUBLE * count(*) / (a + b) AS dice
  FROM each JOIN entries USING (bigram) GROUP BY doc_id, unit, place, passage, license, template, a, b
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place, passage ORDER BY dice DESC, license) AS r
  FROM shared WHERE dice >= {THRESHOLD}
)
SELECT doc_id, unit, place, license, dice FROM ranked WHERE r = 1
"""
