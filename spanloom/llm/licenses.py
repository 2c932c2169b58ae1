"""License scans by canonical digest lookup.

A text in canonical form (case, punctuation, list marks, copyright statements
and equivalent spellings made alike) is hashed, and the digests of whole texts,
of their paragraphs and of their lines are hash-joined to the digests of known
licences. Whole texts are compared without the headings that name a licence.
The known ones are the short notices below and the full texts in
``license_texts``, named by their SPDX identifiers.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence texts and notices by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Spellings that licences count as equal, as (pattern over lower-case words, word).
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("merchantibility", "merchantability"), ("modelling", "modeling"), ("organisation", "organization"), ("organise", "organize"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful")]

#: How a copyright statement begins, and a sentence after it that is more than the statement.
_STATEMENT = "[^a-z0-9\n]*(?:copyright[ \t]*(?:\\(c\\)|©|[0-9]{4}|<|\\[|\\{|by )|\\(c\\)[ \t]*(?:copyright|[0-9]{4}|by )|©)[^\n]*"
_MORE = "\\.[ \t]+((?:released|licensed|distributed|permission|redistribution|this |use of this)[^\n]*)"
#: In order: patterns over lower-case text and what takes their place. Characters beyond ASCII count as letters.
STEPS = [
    (f"^{_STATEMENT}?{_MORE}$", "\\1"),
    (f"^{_STATEMENT}$", ""),
    ("^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", ""),
    ("^[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+", ""),
    ("[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " "),
]
#: A line in canonical form that only names a licence.
HEADING = "^(the )?(mit|isc|x11|zlib|boost|bsd|new bsd|modified bsd|simplified bsd|revised bsd|apache|unlicense|0bsd)( [0-9] clause)?( software)? license( version [0-9 ]+[a-z0-9 ]*)?( (mit|isc|x11|0bsd))?$"
#: Known licences that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the notices and the full texts."""
    return [*KNOWN, *((x.stem, x.read_text()) for x in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))]


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, blank ones too: lower case, words and single spaces, one spelling."""
    plain = F.lower(text)
    for pattern, by in STEPS:
        plain = F.regexp_replace(plain, f"(?md){pattern}", by.replace("\\", "$"))
    alike = plain
    for spelling, word in SPELLINGS:
        alike = F.regexp_replace(alike, f"\\b{spelling}\\b", word)
    plain = F.when(plain.rlike("\\b(" + "|".join(x for x, _ in SPELLINGS) + ")\\b"), alike).otherwise(plain)
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(HEADING)), " ")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, scope, license_id, n: the licences that a row's whole text, a paragraph of several lines or a line is, and how often.

    scope is text, block or line. ``known`` (license_id, text) is canonicalised by
    the same rules; its digests are joined by hash, and broadcast if they are few.
    Null and empty texts and texts of headings and copyright statements alone
    match nothing, repeated rows give repeated results, ids may be null, other
    columns are ignored, an empty table gives an empty result. Texts of any
    length are hashed whole, in time linear in their length.
    """
    digests = known.select("license_id", _whole(canonical_lines(F.col("text"))).alias("whole")).filter("whole <> ''").select("license_id", F.sha2("whole", 256).alias("digest")).distinct()
    digests = F.broadcast(digests) if known.count() <= BROADCAST_ROWS else digests
    lines = docs.select(docs[id_col].cast("long").alias("doc_id"), canonical_lines(docs[text_col]).alias("lines"), F.monotonically_increasing_id().alias("row"))
    blocks = F.filter(F.transform(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda x: F.trim(x, F.lit("\n"))), lambda x: x.contains("\n"))
    unit = lambda scope, text: F.struct(F.lit(scope).alias("scope"), F.sha2(text, 256).alias("digest"))
    whole = F.transform(F.filter(F.array(_whole(F.col("lines"))), lambda x: x != ""), lambda x: unit("text", x))
    each = F.concat(whole, F.transform(blocks, lambda x: unit("block", F.replace(x, F.lit("\n"), F.lit(" ")))), F.transform(F.filter("lines", lambda x: x != ""), lambda x: unit("line", x)))
    units = lines.select("doc_id", "row", F.explode(each).alias("unit")).select("doc_id", "row", "unit.*")
    return units.join(digests, "digest").groupBy("doc_id", "row", "scope", "license_id").agg(F.count("*").alias("n")).select("doc_id", "scope", "license_id", "n")


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(known_texts(), "license_id string, text string")
    return scan(table(spark, sf_dir, "documents"), known)


QUERIES = {"op4_license_digests": op4_license_digests}
ORACLE: dict[str, str] = {}


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    plain = "lower(text)"
    for pattern, by in STEPS:
        plain = f"regexp_replace({plain}, {quoted('(?m)' + pattern)}, {quoted(by)}, 'g')"
    for spelling, word in SPELLINGS:
        plain = f"regexp_replace({plain}, '\\b{spelling}\\b', '{word}', 'g')"
    lines = f"list_transform(string_split({plain}, chr(10)), lambda x: trim(x))"
    whole = f"array_to_string(list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, {quoted(HEADING)})), ' ')"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known_texts())
    return f"""
WITH kl AS (SELECT license_id, {lines} AS lines FROM (VALUES {rows}) AS k(license_id, text)),
known AS (SELECT DISTINCT license_id, sha256({whole}) AS digest FROM kl WHERE {whole} <> ''),
d AS (SELECT doc_id, {lines} AS lines FROM documents),
u AS (
  SELECT doc_id, 'text' AS scope, sha256({whole}) AS digest FROM d WHERE {whole} <> ''
  UNION ALL
  SELECT doc_id, 'block', sha256(replace(x, chr(10), ' ')) FROM (SELECT doc_id, trim(unnest(string_split_regex(array_to_string(lines, chr(10)), '\n\n+')), chr(10)) AS x FROM d) WHERE contains(x, chr(10))
  UNION ALL
  SELECT doc_id, 'line', sha256(x) FROM (SELECT doc_id, unnest(lines) AS x FROM d) WHERE x <> ''
)
SELECT doc_id, scope, license_id, count(*) AS n FROM u JOIN known USING (digest) GROUP BY ALL
"""


ORACLE["op4_license_digests"] = _oracle()
