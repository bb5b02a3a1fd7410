"""License scans: canonical digests of whole texts, joined to those of known licences.

A unit of text (a whole document, a run of paragraphs, a paragraph, or a line) is brought to a
canonical form: lower case, equivalent spellings made equal, title and copyright lines and
punctuation gone, single spaces.  Its digest is joined to the digests of the known licences, so a unit matches only
if its entire text does.

Edge cases: null and empty texts match nothing; a unit that is a copyright line only has an
empty canonical form and matches nothing; a document of one line or paragraph is reported once,
as a document, and a paragraph of one line as a line; a text of title lines only keeps them; repeated rows give repeated hits; known texts with one canonical form all match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.session import broadcast_if_small

#: Known rows that are broadcast, at most; a larger table is joined by a shuffle of digests.
BROADCAST_ROWS = 100_000

# Published licence texts and notices.  Copyright lines are left out; canonical forms drop them.
_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: "
)
_SOURCE_FORM = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. "
)
_BINARY_FORM = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("BSD-2-Clause", _GRANT + "1. " + _SOURCE_FORM + "2. " + _BINARY_FORM + _BSD_WARRANTY),
    ("BSD-3-Clause", _GRANT + "1. " + _SOURCE_FORM + "2. " + _BINARY_FORM + "3. " + _NAMES + _BSD_WARRANTY),
]
# Spellings that count as equal, and the words of which every known text holds one.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", "and"),
]
TITLE = (
    r"(?m)^[^a-z0-9\n]*(the )?(mit|isc|x11|0bsd|((new|modified|simplified|revised) )?bsd([ -]([0-9]|zero)[ -]clause)?|([0-9]|zero)[ -]clause bsd)"
    r"( licen[sc]e)?( \([a-z0-9 -]{1,20}\))?[^a-z0-9\n]*$"
)
#: Words by which the start of a run of paragraphs is looked up.
START_WORDS = 4
KEYWORDS = "(?i)licen[sc]e|permission|redistribut|public domain"


def canonical(text: Column, lone_titles: bool = True) -> Column:
    """Lower case, equal spellings, no title or copyright lines, words separated by single spaces.

    ``lone_titles``: a text of nothing else keeps its title.
    """
    low = F.lower(text)
    low = F.regexp_replace(low, r"(?m)^[^a-z0-9\n]*(copyright( \(c\)| ©|:)?|\(c\)|©)[^a-z0-9\n]*[0-9]{4}[^\n]*$", " ")
    low = F.regexp_replace(low, r"all rights reserved", " ")
    low = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, low)
    plain, bare = (F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")) for x in (low, F.regexp_replace(low, TITLE, " ")))
    return F.when(F.rlike(low, F.lit(TITLE)) & ((bare != "") | F.lit(not lone_titles)), bare).otherwise(plain)


def known_licenses(spark: SparkSession, rows: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license_id, text): the built-in list; a caller may pass any other table of this form."""
    return spark.createDataFrame(rows, "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, keywords: str | None = KEYWORDS) -> DataFrame:
    """(doc_id, license_id, level, position, digest) of every unit whose entire text is a known licence.

    ``level``: document, paragraphs (several in a row, at the first of them), paragraph or line;
    ``position`` counts paragraphs or lines from 0.
    ``keywords``: a pattern that every known text meets, to spare other units the work; null for none.
    """
    one = known.where("text is not null and license_id is not null")
    one = one.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    one = one.select("license_id", F.sha2("form", 256).alias("digest"), _start(F.col("form")).alias("start"), F.size(F.split("form", " ")).alias("n")).distinct()
    one = broadcast_if_small(one, BROADCAST_ROWS)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.where(F.rlike("text", F.lit(keywords))) if keywords else rows
    paragraphs, by_line = F.split("text", r"\n[\x20\t\r]*\n", -1), F.split("text", "\n", -1)

    def units(level: str, parts: Column, several_lines: bool = False) -> Column:
        """The parts as units, none if there is one only, which is the wider unit itself."""
        made = F.transform(parts, lambda x, i: F.struct(F.lit(level).alias("level"), i.cast("bigint").alias("position"), x.alias("unit")))
        made = F.filter(made, lambda u: F.rlike(u["unit"], F.lit(keywords))) if keywords else made
        made = F.filter(made, lambda u: F.contains(u["unit"], F.lit("\n"))) if several_lines else made
        return F.when(F.size(parts) > 1, made).otherwise(F.array().cast("array<struct<level:string,position:bigint,unit:string>>"))

    whole = F.array(F.struct(F.lit("document").alias("level"), F.lit(0).cast("bigint").alias("position"), F.col("text").alias("unit")))
    found = rows.select("doc_id", F.explode(F.concat(whole, units("paragraph", paragraphs, True), units("line", by_line))).alias("u"))
    form = found.select("doc_id", "u.level", "u.position", canonical(F.col("u.unit")).alias("form")).where("form <> ''")
    hashed = form.select("doc_id", "level", "position", F.sha2("form", 256).alias("digest"))
    columns = ["doc_id", "license_id", "level", "position", "digest"]
    return hashed.join(one, "digest").select(columns).union(_runs(rows.select("doc_id", paragraphs.alias("parts")), one).select(columns))


def _start(form: Column) -> Column:
    return F.substring_index(form, " ", START_WORDS)


def _runs(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Known texts that are cut into several paragraphs in a row, but not the whole document, of (doc_id, parts)."""
    forms = F.transform("parts", lambda x, i: F.struct(i.cast("bigint").alias("position"), canonical(x, lone_titles=False).alias("form")))
    rows = rows.where(F.size("parts") > 1).select("doc_id", F.filter(forms, lambda p: p["form"] != "").alias("parts"))
    rows = rows.select("doc_id", F.col("parts.position").alias("positions"), F.col("parts.form").alias("forms"))
    starts = F.transform("forms", lambda x, i: F.struct((i + 1).alias("at"), _start(F.array_join(F.slice("forms", i + 1, START_WORDS), " ")).alias("start")))
    known = F.broadcast(one.agg(F.collect_set("start").alias("known")))
    found = rows.crossJoin(known).withColumn("s", F.explode(F.filter(starts, lambda s: F.array_contains("known", s["start"]))))
    found = found.select("doc_id", "positions", "forms", "s.at", "s.start").join(one, "start")
    run = F.array_join(F.slice("forms", F.col("at"), F.col("n")), " ")
    found = found.withColumn("run", run).withColumn("head", F.expr("substring_index(run, ' ', n)")).where(F.sha2("head", 256) == F.col("digest"))
    most = F.least(F.col("n"), F.size("forms") - F.col("at") + 1)
    ends = F.filter(F.sequence(F.lit(1), most), lambda j: F.array_join(F.slice("forms", F.col("at"), j), " ") == F.col("head"))
    found = found.withColumn("n_parts", F.get(ends, F.lit(0))).where((F.size(ends) > 0) & (F.col("n_parts") > 1) & (F.col("n_parts") < F.size("forms")))
    return found.select("doc_id", "license_id", F.lit("paragraphs").alias("level"), F.get("positions", F.col("at") - 1).alias("position"), "digest")
