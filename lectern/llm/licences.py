"""Licence scan by canonical digests: entire texts, and entire lines, joined to known licences.

A canonical text is in lower case, without punctuation, without copyright lines (a copyright mark or
"(c)" with a year at the start, or "all rights reserved"), white space collapsed, and with one spelling for words that licences spell in several ways.
Its SHA-256 is looked up among the digests of known licences, made the same way.  Only DataFrame
functions are used; the same steps are given as SQL.

Known are the entire texts below ``licence_texts``, those with terms also without the appendix that
follows the terms, the short licences and the one-line notices below.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, each as (other, canonical), of whole words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("behaviour", "behavior"), ("favour", "favor"),
    ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("whilst", "while"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("v2 0", "version 2 0"),
)

# Texts of known licences and notices, without their copyright lines.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known digests up to which they are broadcast (some hundred bytes each); beyond, the join shuffles.
BROADCAST_KNOWN = 100_000


def _whole_texts() -> list[tuple[str, str]]:
    """(licence_id, text) of the files beside this module, and of their terms alone."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, text)] + ([(path.stem, terms + end), (path.stem, terms)] if rest.strip() else [])
    return out


KNOWN = (
    ("MIT", f"MIT License\n{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
     f"included in all copies or substantial portions of the Software.\n{_MIT_END}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in "
     f"all copies or substantial portions of the Software.\n{_MIT_END}"),
    ("MIT-0", f"MIT No Attribution\n{_GRANT}.\n{_MIT_END}"),
    ("ISC", f"ISC License\n{_ISC_USE}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_USE}.\n{_ISC_END}"),
    *_whole_texts(),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
)

#: Canonical lines of a text: SQL that Spark and DuckDB share but for the function names filled in.
_CHARS = r"[^\p{L}\p{N}\n©]+"


def canonical_lines(text: str, duckdb: bool = False) -> str:
    """SQL for the canonical lines of the SQL expression ``text``."""
    chars = _CHARS if duckdb else _CHARS.replace("\\", "\\\\")
    out = f"regexp_replace(lower(coalesce({text}, '')), '{chars}', '  '{", 'g'" if duckdb else ''})"
    out = f"regexp_replace({out}, ' *\n *', ' \n '{", 'g'" if duckdb else ''})"
    out = f"concat(' ', {out}, ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    lines = f"string_split({out}, '\n')" if duckdb else f"split({out}, '\n')"
    each, only = ("list_transform", "list_filter") if duckdb else ("transform", "filter")
    x = "lambda x:" if duckdb else "x ->"
    trimmed = f"{each}({lines}, {x} trim(replace(x, '  ', ' ')))"
    mark = "starts_with" if duckdb else "startswith"
    marks = ("copyright ", "c copyright", "©", "c 19", "c 20", "all rights reserved")
    return f"{only}({trimmed}, {x} x <> '' and {' and '.join(f"not {mark}(x, '{m}')" for m in marks)})"


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(licence_id, digest) of the known texts."""
    rows = spark.createDataFrame(list(known), "licence_id string, text string")
    return digests(rows, "text").select("licence_id", "digest").distinct()


def digests(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``lines``, the canonical lines of the text, and ``digest``, of all of them."""
    lined = rows.withColumn("lines", F.expr(canonical_lines(f"`{text_col}`")))
    return lined.withColumn("digest", F.sha2(F.array_join("lines", " "), 256))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, scope, licence_id): documents whose entire text ('text') or one of whose lines ('line') is a known licence.

    ``known``: (licence_id, digest).  A null, empty or all-punctuation text matches nothing, rows with
    a null id are left out, repeated lines and rows give one row, and a text known as two licences
    gives both.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lined = digests(rows, "text").where(F.size("lines") > 0)
    scopes = F.flatten(
        F.array(
            F.array(F.struct(F.lit("text").alias("scope"), F.col("digest").alias("digest"))),
            F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit("line").alias("scope"), F.sha2(x, 256).alias("digest"))),
        )
    )
    units = lined.select("id", F.explode(scopes).alias("unit")).select("id", "unit.scope", "unit.digest")
    small = known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN
    return units.join(F.broadcast(known) if small else known, "digest").select("id", "scope", "licence_id").distinct()
