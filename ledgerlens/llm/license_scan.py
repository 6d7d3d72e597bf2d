"""License scan by canonical digest lookup (native).

Texts are made canonical (A-Z lower-cased, copyright lines dropped, equivalent
spellings unified, punctuation and white space folded) and their SHA-256 is
hash-joined to the digests of known licence texts, made canonical by the same
expression.  Two kinds of entire text are looked up: the whole document, and
every whole line, since files usually carry a licence as a one-line notice.
The known texts are a fixed list in this module and the digests of whole
licences in ``license_digests.csv`` (made by ``license_texts.py``), a
few hundred rows, so they are broadcast; only one row per (document, licence)
is shuffled.

Null text counts as empty; a long text is normalised and matched whole in its
row; an empty canonical text matches nothing.  Every row
gives a row; rows with equal doc_id and text have equal results.  An empty
table gives an empty result.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_az, pick

# Public licence notices (one entire line each) and entire short licences.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("all-rights-reserved", "All rights reserved."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

# Equivalent spellings of whole words (from, to), after lower-casing and folding.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("https", "http"), ("licence", "license"),
    ("licenced", "licensed"), ("licences", "licenses"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("sublicence", "sublicense"), ("v2", "version 2"), ("v3", "version 3"),
    ("ver", "version"), ("whilst", "while"), ("wilful", "willful"),
]

#: license, digest: canonical digests of whole licences, with and without title lines.
DIGESTS = Path(__file__).with_name("license_digests.csv")

COPYRIGHT_LINE = r"^[ \t]*(?:copyright|\(c\)|©)[^\n]*"
#: Folded: ASCII other than digits, a-z and line ends.
FOLD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text, without empty ones."""
    t = F.regexp_replace(F.replace(lower_az(text), F.lit("&"), F.lit(" and ")), "(?md)" + COPYRIGHT_LINE, "")
    # two spaces between words, so that each word has its own on both sides
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, FOLD, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.filter(lines, lambda x: x != "")


def known(spark: SparkSession) -> DataFrame:
    """digest, license: one row per known canonical text."""
    t = spark.createDataFrame(KNOWN, "license string, text string")
    t = t.select(F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), "license")
    with open(DIGESTS, newline="") as f:
        whole = [(r["digest"], r["license"]) for r in csv.DictReader(f)]
    return t.union(spark.createDataFrame(whole, "digest string, license string")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, document_license, n_notices, licenses, canonical_sha256."""
    texts = known(docs.sparkSession)
    d = pick(docs, doc_id="bigint", text="string")
    d = d.select("doc_id", F.monotonically_increasing_id().alias("row"),
                 canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    d = d.select("doc_id", "row", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"),
                 F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines"))
    whole = F.broadcast(texts.toDF("canonical_sha256", "document_license"))
    d = d.join(whole, "canonical_sha256", "left")
    notices = (
        d.select("row", "doc_id", "document_license", "canonical_sha256", F.explode_outer("lines").alias("digest"))
        .join(F.broadcast(texts), "digest", "left")
    )
    # a document's lines are in one map task: it combines them before the shuffle
    return (
        notices.groupBy("row", "doc_id", "document_license", "canonical_sha256")
        .agg(F.count("license").alias("n_notices"), F.collect_set("license").alias("licenses"))
        .select("doc_id", "document_license", "n_notices",
                F.array_join(F.array_sort("licenses"), ",").alias("licenses"), "canonical_sha256")
    )


def sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '&', ' and '), {lit('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
    t = f"' ' || replace(regexp_replace({t}, {lit(FOLD)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"
    rows = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256(array_to_string({lines}, ' ')) AS digest FROM (VALUES {rows}) v(license, text)),
     d AS (SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents),
     e AS (SELECT row, doc_id, sha256(array_to_string(lines, ' ')) AS canonical_sha256, lines FROM d),
     n AS (SELECT row, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
           FROM (SELECT row, sha256(unnest(lines)) AS digest FROM e) x JOIN k USING (digest) GROUP BY row)
SELECT e.doc_id, k.license AS document_license, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices,
       coalesce(n.licenses, '') AS licenses, e.canonical_sha256
FROM e LEFT JOIN k ON e.canonical_sha256 = k.digest LEFT JOIN n ON e.row = n.row
"""
