"""License scans by canonical digest.

Known license texts and corpus texts are brought to one canonical form (case, punctuation, copyright lines and
equivalent spellings taken away), digested, and matched by a hash join on the digest of the entire text. A
document is matched as a whole, and so is each of its lines and of its paragraphs between blank lines, since short
notices stand on lines of their own or are wrapped.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Known notices, by SPDX-like id; :func:`bodies` has the entire texts.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Equivalent spellings, applied to the lower-cased words in this order.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("v", "version"), ("ver", "version"), ("copyright holder", "copyright owner"))
#: Headings that a text has or lacks, with and without the reservation below its copyright lines.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
}
RESERVED = ("", "All rights reserved.")
END = "END OF TERMS AND CONDITIONS"
#: A line that only states a copyright, not one on which a sentence of a text goes on with these words.
COPYRIGHT_LINE = (
    "(?im)^[ \\t]*(copyright(?![a-z,.;\"”-]|[ \\t]*$|[ \\t]+(holders?|owners?|ownership|notices?|licen[cs]es?|statements?|laws?|interests?|treaty|treaties|permissions?|disclaimers?|doctrines?"
    "|the[ \\t]+(software|library|program|work)|and|or|on|in|is|are|if|to|for|as)\\b)|\\(c\\)(?![ \\t]+(you|under)\\b)|©)[^\\n]*$"
)


def cleaned(text: Column) -> Column:
    """Lower-cased words without copyright lines; line breaks stay, all else between words is a blank. NULL counts as empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " ")
    return F.regexp_replace(F.lower(out), "[[^0-9a-z\\n\\x{80}-\\x{10ffff}][\\x{80}-\\x{10ffff}&&[\\p{P}\\p{S}\\p{Z}]]]+", " ")


def spelled(clean: Column) -> Column:
    """The canonical form of a cleaned text or of one of its lines. Only texts with some of the spellings are gone over for each."""
    some = "(^| )(" + "|".join(spelling for spelling, _ in SPELLINGS) + ")( |$)"

    def standard(text: Column) -> Column:
        # with doubled blanks every word has its own at both ends, so neighbours are replaced as well
        out = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
        for spelling, word in SPELLINGS:
            out = F.replace(out, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {word.replace(' ', '  ')} "))
        return F.when(text.rlike(some), F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(text)

    # a one-element array binds the text once
    return F.get(F.transform(F.array(F.trim(F.regexp_replace(clean, "[ \\n]+", " "))), standard), F.lit(0))


def canonical(text: Column) -> Column:
    return spelled(cleaned(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def bodies() -> list[tuple[str, str]]:
    """The entire texts in ``licenses``: with the headings they come with, with and without clause numbers and what follows their end."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        body = path.read_text(encoding="utf-8")
        forms = {body, body.replace("https://", "http://")}
        if END in body:
            forms |= {f[: f.index(END) + len(END)] for f in forms} | {f[: f.index(END)] for f in forms}
        if path.stem in TITLES:
            forms |= {re.sub(r"(?m)^\d\. ", "", f) for f in forms}
        for title in TITLES.get(path.stem, ("",)):
            for reserved in RESERVED if path.stem in TITLES else ("",):
                out += [(path.stem, f"{title}\n\n{reserved}\n\n{f}") for f in sorted(forms)]
    return out


def known_table(spark: SparkSession, known=None) -> DataFrame:
    """License digests of the known texts (all notices and bodies by default); the first of several with one canonical form stands for it."""
    known = (*KNOWN, *bodies()) if known is None else known
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "place int, license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("digest")).agg(F.min_by("license", "place").alias("license"))


def scan(docs: DataFrame, known=None) -> DataFrame:
    """Licenses of each row (``doc_id``, ``text``; others are ignored).

    Returns ``doc_id, text_sha256, text_license, line_licenses, n_license_lines``: the license whose entire text
    the document is (else NULL), and the licenses that are the entire text of a line or of a paragraph of several
    lines, sorted, with the number of such lines and paragraphs. NULL and empty texts match nothing; repeated rows are each returned. Texts are
    cleaned once, whole and lines are joined in the same pass, and only matches and one row a document are shuffled.
    """
    table = F.broadcast(known_table(docs.sparkSession, known))  # as many rows as the parameter has
    # one-row generators: the costly expressions are worked out once
    clean = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(cleaned(F.col("text")))).alias("clean"))
    paragraphs = F.split("clean", "\\n *\\n[ \\n]*")
    wrapped = F.filter(paragraphs, lambda p: (F.size(paragraphs) > 1) & (F.instr(F.btrim(p, F.lit(" \n")), "\n") > 0))
    parts = clean.select("row", "doc_id", F.posexplode(F.concat(F.array("clean"), F.split("clean", "\\n"), wrapped)).alias("part", "body"))
    digests = parts.select("row", "doc_id", "part", F.explode(F.array(F.sha2(spelled(F.col("body")).cast("binary"), 256))).alias("digest"))
    whole = F.col("part") == 0
    kept = digests.join(table, "digest", "left").where(whole | F.col("license").isNotNull())
    kept = cut(kept, "licenses")  # row numbers hold for one reading of the table only: they are written with what they number
    line = F.when(~whole, F.col("license"))
    return kept.groupBy("row", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_sha256"),
        F.max(F.when(whole, F.col("license"))).alias("text_license"),
        F.array_join(F.sort_array(F.collect_set(line)), ",").alias("line_licenses"),
        F.count(line).alias("n_license_lines"),
    ).drop("row")
