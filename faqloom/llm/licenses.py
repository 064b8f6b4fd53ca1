"""Licence scan by canonical digests.

A text's canonical form has A-Z in lower case, no copyright lines, one spelling for words that count as equal, and single
blanks for everything that is neither a letter nor a digit.  Its SHA-256 is joined with the digests of known licence
texts.  A line
is a copyright line if a sign or a year follows the word.  Entire texts are compared: a document as a whole, and each of its lines, since a notice is often a line of its
own.  The known digests are broadcast if their rows and bytes were found to be small, else joined by a shuffle.

Defined cases: a null text, and one without letters and digits, has the digest of the empty form and no licence; a line
that repeats counts once; null and repeated ids stay rows of their own; known texts with the same canonical form give
the smallest name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.llm.common import ascii_lower, is_small
from faqloom.llm.license_digests import DIGESTS
from faqloom.session import materialize

#: Spellings that count as equal.  Fixed values, in the form they have after signs became blanks.
EQUAL = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("authorised", "authorized"),
    ("favour", "favor"), ("behaviour", "behavior"), ("per cent", "percent"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("whilst", "while"), ("fulfil", "fulfill"),
)
#: A copyright notice: a sign, a year or the place for one follows the word, as it follows a bare (c).
COPYRIGHT = (
    r"(?m)^[\t\f\r ]*(copyright[\t ]*(\(c\)|©|&copy;|[\[<{(]?([0-9]{4}|year|yyyy)\b)|\(c\)[\t ]*(copyright[\t ]*)?[0-9]{4}\b|©)[^\n]*$"
)
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©–—‘’“”]+"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
#: Known texts: licences and the notices that name one.  A parameter; these are fixed public values.
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("reserved", "All rights reserved."),
)

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: Identifiers of the SPDX list whose notices are known, and the long names that notices use.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0-Perl Artistic-2.0 BSD-2-Clause "
    "BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OpenSSL PostgreSQL Python-2.0 "
    "Unlicense Vim WTFPL Zlib"
).split()
LONG = (
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MIT", "MIT License"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("Unlicense", "The Unlicense"),
)
OPENINGS = tuple(
    a + b for a in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This code is ")
    for b in ("licensed under ", "licensed under the ", "released under ", "released under the ", "distributed under the ")
) + ("License: ", "SPDX-License-Identifier: ")
#: What is known besides; whole texts, and notices in the plain wordings.
MORE = (
    *((n, title + text + "\n" + BSD_END) for n, text, titles in (
        ("BSD-2-Clause", BSD_2, ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")),
        ("BSD-3-Clause", BSD_3, ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n"))) for title in titles),
    *(("Unlicense", t) for t in (UNLICENSE, UNLICENSE.replace("https", "http"))),
    *((n, o + name + end) for n, name in (*((s, s) for s in SPDX), *LONG) for o in OPENINGS for end in ("", " license")),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    low = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    out = F.regexp_replace(low, SIGNS, " ")
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for other, word in EQUAL:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(name, text), and where there is no text a canonical digest if known has such a column -> digest, name."""
    given = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    forms = known.select("name", given.alias("given"), canonical(F.col("text")).alias("form")).filter("given IS NOT NULL OR form <> ''")
    return forms.groupBy(F.coalesce("given", F.sha2("form", 256)).alias("digest")).agg(F.min("name").alias("name"))


def known_texts(spark: SparkSession) -> DataFrame:
    # without line ends: how these texts are wrapped here says nothing
    rows = [(name, " ".join(text.split()), None) for name, text in (*KNOWN, *MORE)] + [(name, None, digest) for name, digest in DIGESTS]
    return spark.createDataFrame(rows, "name string, text string, digest string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, digest, license (of the whole text) and notices (names of its lines, comma-joined)."""
    names = materialize(known_digests(known), "license-digests")
    names = F.broadcast(names) if is_small(names) else names.hint("merge")
    own = docs.select(
        F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("row"), "doc_id", digest(F.col("text")).alias("digest"), "text"
    )
    # a line meets the known digests where it is read; what met nothing ends there, but for one row per document
    lines = own.select("row", "doc_id", F.col("digest").alias("whole"), F.explode(
        F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.split("text", "\n"), F.array())))
    ).alias("line"))
    looked = lines.withColumn("digest", F.when(F.col("line").isNull(), F.col("whole")).otherwise(digest(F.col("line"))))
    met = looked.join(names, "digest", "left").filter(F.col("line").isNull() | F.col("name").isNotNull())
    per = met.groupBy("row", "whole").agg(
        F.sum(F.col("line").isNull().cast("bigint")).alias("copies"),
        F.max(F.when(F.col("line").isNull(), F.col("name"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line").isNotNull(), F.col("name")))), ",").alias("notices"),
    )
    rows = per.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.col("whole").alias("digest"), "license", "notices")


def _sql_canonical(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace(regexp_replace({low}, '{COPYRIGHT}', ' ', 'g'), '{SIGNS}', ' ', 'g') || ' '"
    for other, word in EQUAL:
        out = f"replace({out}, ' {other} ', ' {word} ')"
    return f"trim({out})"


def _sql_known() -> str:
    """The same known texts and digests as :func:`known_texts`; the texts' digests are the SQL's own work."""
    rows = ", ".join("('{}', '{}')".format(n, " ".join(t.split()).replace("'", "''")) for n, t in (*KNOWN, *MORE))
    given = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return (f"SELECT digest, min(n) AS name FROM (SELECT n, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {rows}) k(n, t) "
            f"UNION ALL SELECT n, d FROM (VALUES {given}) g(n, d)) GROUP BY 1")


ORACLE = f"""
WITH k AS ({_sql_known()}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
l AS (
  SELECT DISTINCT rid, name FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)
  JOIN k ON sha256({_sql_canonical("line")}) = k.digest),
n AS (SELECT rid, string_agg(name, ',' ORDER BY name) AS notices FROM l GROUP BY rid)
SELECT doc_id, d.digest, k.name AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN n USING (rid)
"""
