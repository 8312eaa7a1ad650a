"""Case notes: headed free text, and the list of tried prefixes.

Both readers work inside the row of a note, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import let, strip
from proofmill.operators.shape import exploded

# How a header line begins, and the section it opens.
SECTION_HEADERS = {
    "EVOSUITE PREFIX": "evosuite_prefix",
    "EVOSUITE ASSERTION": "regression_oracle",
    "DEV-WRITTEN PREFIX": "dev_prefix",
    "DEV-WRITTEN ASSERTION": "dev_assertion",
    "TRUE ASSERTION": "true_assertion",
    "METHOD UNDER TEST": "method_under_test",
    "NOTES": "notes",
}

_CASE = r"(?m)^[ \t]*([A-Za-z]+)[ \t]+(\d+)[ \t]*$"
_HEADER = r"^(" + "|".join(SECTION_HEADERS) + r")(?![A-Za-z])"


def sections_of(lines, is_header):
    """Array of (i, head, body_lines) cut at header lines; the text above the first is left out."""
    numbered = F.transform(lines, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    heads = F.filter(numbered, lambda x: is_header(x["s"]))

    def cut(both):
        def section(h, k):
            end = F.coalesce(F.try_element_at(both["heads"], k + 2)["i"], F.size(both["lines"]))
            return F.struct(
                h["s"].alias("head"), (k + 1).alias("seq"),
                F.slice(both["lines"], h["i"] + 2, end - h["i"] - 1).alias("body_lines"),
            )

        return F.transform(both["heads"], section)

    return let(F.struct(lines.alias("lines"), heads.alias("heads")), cut)


def case_sections(notes: DataFrame) -> DataFrame:
    """notes(path, content) → bug_project, bug_id, section, seq, body."""
    cut = sections_of(F.split("content", "\n", -1), lambda s: strip(s).rlike(_HEADER))
    named = F.create_map(*[F.lit(x) for pair in SECTION_HEADERS.items() for x in pair])
    return notes.select(
        F.regexp_extract("content", _CASE, 1).alias("bug_project"),
        F.regexp_extract("content", _CASE, 2).try_cast("bigint").alias("bug_id"),
        cut.alias("cut"),
    ).transform(exploded, F.col("cut"), "x").select(
        "bug_project", "bug_id",
        F.try_element_at(named, F.regexp_extract(strip(F.col("x.head")), _HEADER, 1))
        .alias("section"),
        "x.seq", strip(F.array_join("x.body_lines", "\n")).alias("body"),
    )


def bad_prefixes(notes: DataFrame) -> DataFrame:
    """notes(path, content) → bug_project, bug_id, test_no; one row per tried test."""
    cut = sections_of(
        F.split("content", "\n", -1), lambda s: s.rlike(_CASE)
    )
    tried = F.regexp_extract_all(
        F.array_join("x.body_lines", "\n"), F.lit(r"tried:[ \t]*([0-9, \t]+)"), F.lit(1)
    )
    return (
        exploded(notes, cut, "x")
        .select(
            F.regexp_extract("x.head", _CASE, 1).alias("bug_project"),
            F.regexp_extract("x.head", _CASE, 2).try_cast("bigint").alias("bug_id"),
            F.explode(F.split(F.array_join(tried, ","), ",")).alias("no"),
        )
        .select("bug_project", "bug_id", strip(F.col("no")).try_cast("int").alias("test_no"))
        .filter("test_no IS NOT NULL")
    )
