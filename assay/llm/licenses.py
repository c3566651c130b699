"""Licence scans by canonical digest.

A text is brought to one canonical form: lower case, no copyright lines, words alone, one
spelling of each word. Its digest is then joined with the digests of known licences, for the
whole text and, for the notices that documents carry, for each whole line. Everything is SQL
expressions, built once here for Spark and once for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import staged

# Spellings that count as the same, the second taking the place of the first.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("https", "http"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
]

# Texts of licences and of notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the Software. "
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = [
    ("MIT", _MIT + _WARRANTY),
    ("MIT", "MIT License " + _MIT + _WARRANTY),
    ("MIT", "The MIT License (MIT) " + _MIT + _WARRANTY),
    ("MIT-0", _MIT.partition(", subject to")[0] + ". " + _WARRANTY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ". " + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: Full texts of longer licences, by digest and length of their canonical text. They were taken from
#: /usr/share/common-licenses, whole and, where there is one, without the appendix on how to apply.
FULL = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", 9887),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", 8871),
    ("GPL-1.0", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6", 11797),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", 22277),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", 22447),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 14341),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", 19583),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", 22018),
]

#: A line that names who holds the copyright and when; "copyright holders be liable" is none.
COPYRIGHT = (
    r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(c[^a-z0-9\n]+)?([0-9]{4}|year|yyyy)|\(c\)[^a-z0-9\n]*[0-9]{4}|©|all rights reserved)[^\n]*"
)
#: What parts words; lines stay apart.
GAP = r"[^\p{L}\p{N}\n]+"
#: Line ends, without blanks and empty lines around them.
LINE_END = r" ?\n[ \n]*"


def _spelled(words: str) -> str:
    """Each word between spaces of its own, so that neighbours do not share one."""
    return " " + words.replace(" ", "  ") + " "


def canonical_lines(text: Column) -> Column:
    """The text in canonical words, line by line; a null text is an empty one."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT, "")
    out = F.regexp_replace(out, GAP, " ")
    out = F.regexp_replace(out, LINE_END, "\n")
    out = F.concat(F.lit(" "), F.replace(F.replace(out, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(_spelled(old)), F.lit(_spelled(new)))
    return out


def canonical(lines: Column) -> Column:
    """Canonical lines, or one of them, as words with one space between."""
    return F.trim(F.replace(F.replace(lines, F.lit(" \n "), F.lit("  ")), F.lit("  "), F.lit(" ")))


def digest(lines: Column) -> Column:
    return F.sha2(canonical(lines), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, digest, size) of the known texts, each digest once: the least name wins. `size`
    is the length of the canonical text."""
    cells = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    rows = spark.range(1).select(F.inline(cells)).withColumn("lines", canonical_lines(F.col("text")))
    found = rows.groupBy(digest(F.col("lines")).alias("digest"))
    return found.agg(F.min("license").alias("license"), F.min(F.length(canonical(F.col("lines")))).alias("size"))


def full_digests(spark: SparkSession) -> DataFrame:
    """(license, digest, size) of FULL."""
    cells = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(d).alias("digest"), F.lit(s).alias("size")) for n, d, s in FULL])
    return spark.range(1).select(F.inline(cells))


def scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, license, notices): one row per row of `docs`.

    `text_sha256` is the digest of the whole canonical text and `license` the known licence of
    that digest, null if there is none. `notices` are the licences of whole lines, sorted and
    comma-joined, empty if none; rows of one id and one digest share theirs. A null, empty or
    wordless text has the digest of the empty text, which is no licence's. Ids may be null or
    repeated. `known` has (license, digest, size), one row per digest; Spark joins it by broadcast
    if its size allows, and the distinct sizes, few for any list of licences, stand in the plan.
    """
    if known is None:
        known = known_digests(docs.sparkSession).unionByName(full_digests(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    # Only a line as long as a known text can be one; the others are not hashed.
    sizes = [r["size"] for r in known.select("size").distinct().collect()]
    short = F.filter(F.transform(F.split("lines", "\n"), canonical), lambda line: F.length(line).isin(sizes))
    rows = rows.select("id", digest(F.col("lines")).alias("text_sha256"), F.transform(short, lambda line: F.sha2(line, 256)).alias("lines"))
    rows = staged(rows, "license_digests")  # digests alone, so that texts are read once
    names = known.select("digest", "license")
    whole = rows.select("id", "text_sha256").join(names.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    hits = (
        rows.select(F.col("id").alias("i"), F.col("text_sha256").alias("t"), F.explode("lines").alias("digest"))
        .join(names.withColumnRenamed("license", "notice"), "digest")
        .groupBy("i", "t")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("notice"))).alias("notices"))
    )
    found = whole.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("t")), "left")
    return found.select(F.col("id").alias(id_col), "text_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT)}, '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {_quoted(GAP)}, ' ', 'g'), {_quoted(LINE_END)}, chr(10), 'g')"
    out = f"' ' || replace(replace({out}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(_spelled(old))}, {_quoted(_spelled(new))})"
    return out


def _digest_sql(lines: str) -> str:
    return f"sha256(trim(replace(replace({lines}, ' ' || chr(10) || ' ', '  '), '  ', ' ')))"


ORACLE = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, {_digest_sql(_canonical_lines_sql("text"))} AS digest
    FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) AS k(license, text)
    UNION ALL
    SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d, _ in FULL)}) AS f(license, digest))
  GROUP BY digest),
lines AS (SELECT doc_id, {_canonical_lines_sql("text")} AS lines FROM documents),
rows AS (SELECT doc_id, lines, {_digest_sql("lines")} AS text_sha256 FROM lines),
notices AS (
  SELECT doc_id, text_sha256, string_agg(license, ',' ORDER BY license) AS notices FROM (
    SELECT DISTINCT l.doc_id, l.text_sha256, k.license
    FROM (SELECT doc_id, text_sha256, unnest(string_split(lines, chr(10))) AS line FROM rows) l
    JOIN known k ON k.digest = {_digest_sql("l.line")})
  GROUP BY doc_id, text_sha256)
SELECT r.doc_id, r.text_sha256, k.license, coalesce(n.notices, '') AS notices
FROM rows r LEFT JOIN known k ON k.digest = r.text_sha256
LEFT JOIN notices n ON n.doc_id IS NOT DISTINCT FROM r.doc_id AND n.text_sha256 = r.text_sha256
"""
