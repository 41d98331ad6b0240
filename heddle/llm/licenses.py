"""License scan: texts are brought to one canonical form and hash-joined, whole, to known digests."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import pick

#: Anchors that are tried one by one on every text.
MOST_ANCHORS = 64

# Comment signs, and the forms of a copyright notice on a line of its own: the sign and a year or name, a year alone, or a
# name and a year at the line's end. "(c)" alone counts list items, and a blank to fill in is part of the text. A line
# "all rights reserved" behind it belongs to it. None of these reaches into what a wrapped license says.
SIGNS = r"[ \t#*/;-]*"
COPYRIGHT_LINE = (
    rf"(?m)^{SIGNS}(?:(?:copyright[ \t]*(?:©|\(c\))|©)[ \t]*(?:[0-9]{{4}}|\p{{L}})|copyright[ \t,:]*[0-9]{{4}}|copyright[ \t]+[\p{{L}}., \t]{{1,60}}[ \t][0-9]{{4}}[ \t.]*$)"
    rf"[^\n]{{0,200}}$(?:\s*\n{SIGNS}all rights reserved[.]?[ \t]*$)?"
)
#: The notice of a license's own text, which every copy has; it stays, whatever the wrapping puts behind it.
OWN_NOTICE = (r"copyright\s*\(c\)([\s0-9,-]+free\s+software\s+foundation|\s+year\s+(?:your\s+name|name\s+of\s+author))", "copyrighted ")
NO_WORD = r"[^\p{L}\p{N}]+"

# Spellings that the public matching guidelines for license texts call equivalent.
EQUIVALENT = [
    ("acknowledgment", "acknowledgement"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# The usual one-line notices.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# What holders of the same license write differently. The first is how the shipped texts have it.
ADDRESSES = (r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
LIST_NUMBER = r"(?m)^[ \t]*[0-9]\.[ \t]"


def full_texts() -> list[tuple[str, str]]:
    """The licenses of the folder license_texts, whole, with each of their titles and without, with their appendix and without,
    with either address of the Free Software Foundation, the lists of the short ones numbered or not, and those that hold a
    notice in one line too.

    A file is named after its license, with a variant's name behind a plus sign. It has the titles, one a line, then the text, then
    what may follow it; lines of two percent signs part them. The shortest come first."""
    found = []
    for file in sorted((files("heddle.llm") / "license_texts").iterdir(), key=lambda f: f.name):
        if not file.name.endswith(".txt"):
            continue
        name = file.name.removesuffix(".txt").split("+")[0]
        titles, body, *more = file.read_text(encoding="utf-8").split("\n%%\n")
        for tail in ("", *more):
            text = f"{body}\n{tail}".strip("\n")
            texts = {text: 0, re.sub(*ADDRESSES, text): 0, **({re.sub(LIST_NUMBER, " ", text): 0} if name.startswith("BSD") else {})}
            whole = [f"{title}\n{x}".lstrip("\n") for title in ("", *titles.split("\n")) for x in texts]
            found += [(name, x) for x in whole]
            # in one line, where a notice of its own cannot be told from what follows it
            found += [(name, line) for x in whole if (line := " ".join(x.split())) and re.search(r"(?i)copyright \(c\) [a-z]", line)]
    return sorted(found, key=lambda row: len(row[1]))


KNOWN = NOTICES + full_texts()


def plain(text: Column) -> Column:
    """Lower case, no copyright lines, words parted by one blank."""
    out = F.regexp_replace(F.lower(text), OWN_NOTICE[0], OWN_NOTICE[1] + "$1")
    for pattern in (COPYRIGHT_LINE, NO_WORD):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def spelled(words: Column) -> Column:
    """One spelling of each word. No replacement changes the number of words or a word's first two letters."""
    for other, one in EQUIVALENT:
        words = F.regexp_replace(words, rf"\b{other}\b", one)
    return words


def _keys(df: DataFrame, text: str) -> DataFrame:
    """The plain text, how many blanks it has and how it begins: what equivalent spellings have in common."""
    return df.withColumn("plain", plain(F.col(text))).withColumn("blanks", F.length("plain") - F.length(F.translate("plain", " ", ""))).withColumn("head", F.substring("plain", 1, 2))


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """Digest, license, blanks, head and anchor of each known text; of several licenses with one digest the first by name.
    The anchor is the longest word that has one spelling only, or null. Texts without words are left out. The texts are
    read once: the rows, some bytes for each, come from the driver, which has the list."""
    rows = _keys(spark.createDataFrame(texts, "license string, body string"), "body").filter("plain != ''")
    several = sorted({word for pair in EQUIVALENT for word in " ".join(pair).split()})
    fixed = F.filter(F.split("plain", " "), lambda w: ~w.isin(several))
    anchor = F.array_max(F.transform(fixed, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    found = rows.groupBy(F.sha2(spelled(F.col("plain")), 256).alias("digest"), "blanks", "head").agg(F.min("license").alias("license"), F.min(anchor).alias("anchor"))
    return spark.createDataFrame(found.collect(), found.schema)


def _anchored(licenses: DataFrame) -> Callable[[Column], Column]:
    """A cheap test that every text passes that may be a known one: its lower case contains an anchor. Always true
    where a known text has none or there are too many to try; the result is the same."""
    found = [r.anchor for r in licenses.select("anchor").distinct().limit(MOST_ANCHORS + 1).collect()]
    if None in found or len(found) > MOST_ANCHORS:
        return lambda text: F.lit(True)
    return lambda text: reduce(lambda a, b: a | b, [F.lower(text).contains(word) for word in found], F.lit(False))


def _identified(units: DataFrame, text: str, licenses: DataFrame) -> DataFrame:
    """The rows whose whole text is a known one, with `license`. Only rows that agree with some known text in blanks and head
    are spelled alike and digested; no other can have its digest."""
    alike = _keys(units, text).join(licenses.select("blanks", "head").distinct(), ["blanks", "head"]).drop("blanks", "head")
    return alike.withColumn("digest", F.sha2(spelled(F.col("plain")), 256)).join(licenses.select("digest", "license"), "digest").drop("plain", "digest")


def license_scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): `license`, whose known text the whole document is, or null;
    `n_notices`, how many of its lines are a known text; `notices`, their licenses, sorted and comma-joined.

    `licenses` is what `known` gives. Nothing is broadcast by hand: the planner does so for a small list.
    A null text, and a text or line without words, matches nothing. Repeated rows each get their result.
    Copyright notices on lines of their own are dropped before the comparison, and the wrapping does not count. A license of
    several lines matches as a whole document only.
    """
    rows = pick(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    may_be = _anchored(licenses)
    every = rows.select("doc_id", "row").alias("e")
    rows = rows.filter(may_be(F.col("text")))
    whole = _identified(rows, "text", licenses).groupBy("doc_id", "row").agg(F.min("license").alias("license"))
    lines = rows.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "row", "at", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(may_be(F.col("line")))
    found = (
        _identified(lines, "line", licenses)
        .groupBy("doc_id", "row", "at")
        .agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
        .groupBy("doc_id", "row")
        .agg(F.first("n_notices").alias("n_notices"), F.first("notices").alias("notices"))
    )

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.row").eqNullSafe(F.col(f"{b}.row"))

    met = every.join(whole.alias("w"), same("e", "w"), "left").join(found.alias("f"), same("e", "f"), "left")
    return met.select(
        "e.doc_id",
        "w.license",
        F.coalesce("f.n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("f.notices", F.lit("")).alias("notices"),
    )


def oracle() -> str:
    """The same over the documents table, in DuckDB's SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canon(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(OWN_NOTICE[0])}, {quoted(OWN_NOTICE[1] + chr(92) + '1')}, 'g')"
        for pattern in (COPYRIGHT_LINE, NO_WORD):
            out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
        for other, one in EQUIVALENT:
            out = f"regexp_replace({out}, {quoted(rf'\b{other}\b')}, {quoted(one)}, 'g')"
        return f"trim({out})"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT {canon("body")} AS digest, min(license) AS license FROM (VALUES {values}) v(license, body) GROUP BY 1),
 whole AS (SELECT row_number() OVER () AS r, doc_id, text, {canon("text")} AS digest FROM documents),
 lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM whole),
 found AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
           FROM (SELECT r, {canon("line")} AS digest FROM lines) x JOIN known USING (digest) GROUP BY r)
SELECT doc_id, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
"""
