"""Licence texts found by digest: texts are brought to a canonical form and hash-joined."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from importlib.resources import files
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import BROADCAST_ROWS

# Public licence texts and the notices by which works refer to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", 'The BSD 2-Clause License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "Unlicense": ("The Unlicense",),
}


def _whole_texts() -> Iterator[tuple[str, str]]:
    """The texts in `licence_texts`, with and without what follows their terms, and with titles."""
    folder = files(__package__) / "licence_texts"
    for file in sorted(folder.iterdir(), key=lambda x: x.name):
        name = file.name.removesuffix(".txt")
        text = file.read_text("utf-8").strip("\n")
        texts = [text]
        if name.startswith("BSD-"):
            # The clauses are marked by signs or by numbers.
            numbers = count(1)
            texts.append(re.sub(r"(?m)^ *\* ", lambda m: f"{next(numbers)}. ", text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            texts += [terms, terms + end]
        for x in texts:
            yield name, x
            for title in _TITLES.get(name, ()):
                yield name, title + "\n\n" + x


def _notices() -> Iterator[tuple[str, str]]:
    """Notices by which works refer to a licence, by family and version."""
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for verb in ("Licensed", "Released"):
                yield f"CC-{kind}-{version}", f"{verb} under CC {kind} {version}."
            yield f"CC-{kind}-{version}", f"SPDX-License-Identifier: CC-{kind}-{version}"
    gnu = (
        ("GPL", "GNU General Public License", ("1", "2", "3")),
        ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
        ("AGPL", "GNU Affero General Public License", ("3",)),
    )
    for family, title, versions in gnu:
        for version in versions:
            name = f"{family}-{version if '.' in version else version + '.0'}"
            for start in ("Licensed", "Released", "This work is licensed"):
                yield name, f"{start} under the {title}, version {version}."
            for suffix in ("", "-only", "-or-later"):
                yield name, f"SPDX-License-Identifier: {name}{suffix}"
    others = (
        ("BSD-2-Clause", "BSD 2-Clause License"),
        ("BSD-3-Clause", "BSD 3-Clause License"),
        ("BSL-1.0", "Boost Software License, Version 1.0"),
        ("ISC", "ISC License"),
        ("MPL-2.0", "Mozilla Public License, version 2.0"),
        ("Unlicense", "Unlicense"),
    )
    for name, title in others:
        yield name, f"Licensed under the {title}."
        yield name, f"Released under the {title}."
        yield name, f"SPDX-License-Identifier: {name}"
    yield "CC0-1.0", "Released under CC0 1.0."
    yield "CC0-1.0", "SPDX-License-Identifier: CC0-1.0"


CATALOGUE = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *_whole_texts(),
    *_notices(),
)

# What is rewritten, in this order, once a text is in lower case. Line ends stay.
# Lines that claim copyright, with a sign or a year or its place, go; what is no letter or digit becomes a space; of equivalent
# spellings the American one stays, also inside longer words.
RULES = (
    (
        "(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(©|\\(c\\)|[0-9]{4}|yyyy|year)|©"
        "|\\(c\\)[^a-z0-9\n]*(copyright|[0-9]{4}|yyyy|year)|all rights reserved)[^\n]*",
        "$1",
    ),
    ("[^a-z0-9\n\\x{c0}-\\x{1fff}\\x{3040}-\\x{10ffff}]+", " "),
    (" *\n *", "\n"),
    ("licenc", "licens"),
    ("i[sz](ation|e|ed|es|ing)([ \n]|$)", "iz$1$2"),
    ("(fav|col|hon|behavi|lab|neighb)our", "$1or"),
    ("(acknowledg|judg)ement", "$1ment"),
    ("(sub|non) (licens|infring)", "$1$2"),
)


# What RULES write in another way, as plain pairs.
SPELLINGS = (
    *((f"{x}our", f"{x}or") for x in ("fav", "col", "hon", "behavi", "lab", "neighb")),
    *((f"{x}ement", f"{x}ment") for x in ("acknowledg", "judg")),
    *((f"{x} {y}", f"{x}{y}") for x in ("sub", "non") for y in ("licens", "infring")),
)
_CLAIMS = ("copyright", "©", "(c)", "all rights reserved")
_KEPT = "a-z0-9\n\\x{c0}-\\x{1fff}\\x{3040}-\\x{10ffff}"


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, with its line ends; a null text is empty.

    This is what RULES say, with patterns only where plain replacement cannot do: claims are looked
    for in texts that have such a word, single spaces are not replaced by themselves, and once there
    are only single spaces, those around line ends and other spellings are plain strings.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    claims = reduce(Column.__or__, (F.contains(out, F.lit(x)) for x in _CLAIMS))
    pattern, instead = RULES[0]
    out = F.when(claims, F.regexp_replace(out, F.lit(pattern), F.lit(instead))).otherwise(out)
    out = F.regexp_replace(out, F.lit(f"[^ {_KEPT}][^{_KEPT}]*| [^{_KEPT}]+"), F.lit(" "))
    for old, new in ((" \n", "\n"), ("\n ", "\n"), ("licenc", "licens")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, F.lit("is(ation|e|ed|es|ing)([ \n]|$)"), F.lit("iz$1$2"))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _whole(lines: Column) -> Column:
    """Canonical lines as one line; spaces within them are single already."""
    return F.trim(F.regexp_replace(lines, F.lit("\n+"), F.lit(" ")))


def catalogue(spark: SparkSession, known=CATALOGUE) -> DataFrame:
    """`digest` and `licence` of known texts; of ids with the same digest the first by name."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return (
        rows.select("licence", F.sha2(_whole(canonical_lines(F.col("text"))), 256).alias("digest"))
        .groupBy("digest")
        .agg(F.min("licence").alias("licence"))
    )


def scan_licences(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document with the licences whose entire text it, or one of its lines, is.

    Columns: `doc_id`, `text_digest` (SHA-256 of the canonical text), `text_licence` (null if the
    text is not a known one as a whole), `n_licence_lines`, and `licences`, all ids found, in order
    and joined by commas (empty if none). Null counts as empty, and an empty text matches nothing.
    Repeated rows count once, rows without an id are left out; other columns are not read; no rows
    give no rows.

    Everything is expressions and a join by digest. A text is brought to its form once, and its lines
    follow it through the join; only digests of whole texts and of lines that match are grouped. The
    known digests, one row each, are broadcast if they were counted and are few.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines")
    )
    known = known.select("digest", "licence")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # The whole text has place 0, its lines follow.
    units = F.concat(F.array(_whole(F.col("lines"))), F.split("lines", "\n"))
    found = (
        texts.select("doc_id", F.posexplode(units).alias("place", "unit"))
        .withColumn("unit", F.trim("unit"))
        .where("place = 0 or unit <> ''")
        .select("doc_id", "place", F.sha2("unit", 256).alias("digest"))
        .join(known, "digest", "left")
        .where("place = 0 or licence is not null")
        .distinct()
    )
    entire = F.when(F.col("place") == 0, F.struct("digest", "licence"))
    line = F.when(F.col("place") > 0, F.col("licence"))
    grouped = found.groupBy("doc_id").agg(
        F.collect_set(entire).alias("entire"),
        F.count(line).alias("n_licence_lines"),
        F.collect_set(line).alias("ids"),
    )
    ids = F.array_distinct(F.array_compact(F.array_append("ids", F.col("entire.licence"))))
    return grouped.withColumn("entire", F.explode("entire")).select(
        "doc_id",
        F.col("entire.digest").alias("text_digest"),
        F.col("entire.licence").alias("text_licence"),
        "n_licence_lines",
        F.array_join(F.sort_array(ids), ",").alias("licences"),
    )


def oracle(known=CATALOGUE) -> str:
    """The same in DuckDB's SQL."""

    def canonical(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern, instead in RULES:
            pattern = pattern.replace("\n", "\\n").replace("'", "''")
            instead = instead.replace("$", "\\")
            out = f"regexp_replace({out}, '{pattern}', {_sql(instead)}, 'g')"
        return out

    def whole(text: str) -> str:
        return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"

    values = ", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in known)
    return f"""
WITH known AS (
  SELECT sha256({whole(canonical('text'))}) AS digest, min(licence) AS licence
  FROM (VALUES {values}) v(licence, text) GROUP BY 1),
texts AS (SELECT doc_id, {canonical('text')} AS canon FROM documents),
entire AS (
  SELECT t.doc_id, sha256({whole('canon')}) AS digest FROM texts t),
line AS (
  SELECT doc_id, unnest(string_split(canon, chr(10))) AS line FROM texts),
found AS (
  SELECT l.doc_id, k.licence FROM line l JOIN known k ON sha256({whole('l.line')}) = k.digest),
every AS (
  SELECT doc_id, licence FROM found
  UNION SELECT e.doc_id, k.licence FROM entire e JOIN known k ON e.digest = k.digest)
SELECT e.doc_id, e.digest AS text_digest, k.licence AS text_licence,
  (SELECT count(*) FROM found f WHERE f.doc_id = e.doc_id) AS n_licence_lines,
  coalesce((SELECT string_agg(licence, ',' ORDER BY licence) FROM every a WHERE a.doc_id = e.doc_id),
    '') AS licences
FROM entire e LEFT JOIN known k ON e.digest = k.digest"""


def _sql(text: str) -> str:
    if text.count("\n") > 50:
        # A long chain of concatenations is too deep an expression.
        return "replace('" + text.replace("'", "''").replace("\n", "¶") + "', '¶', chr(10))"
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
