"""What a test checks: values, an expected exception, both, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import text


def oracle_kind(code: Column, skip_comments: bool = False) -> Column:
    source = text.line_comments_out(code) if skip_comments else code
    value = source.rlike(r"assert\w*\(")
    exception = text.exception_label(source) & source.contains("verifyException(")
    return (
        F.when(value & exception, "both").when(value, "value").when(exception, "exception")
        .otherwise("none")
    )


def expected_exception(code: Column) -> Column:
    """Struct of exception_type, verified_class and message; empty strings when absent."""
    block = F.regexp_extract(
        code, r"(?s)catch\s*\([^)]*\)\s*\{(.*?)verifyException", 1
    )
    notes = F.transform(
        F.split(block, "\n"), lambda s: text.strip(F.regexp_replace(text.strip(s), r"^//", ""))
    )
    return F.struct(
        F.regexp_extract(code, r"catch\s*\(\s*(?:final\s+)?([\w$.]+)", 1).alias("exception_type"),
        F.regexp_extract(code, r'verifyException\(\s*"([^"]*)"', 1).alias("verified_class"),
        F.array_join(F.filter(notes, lambda s: s != ""), " ").alias("message"),
    )


def section_distances(sections: DataFrame) -> DataFrame:
    """Edit distances within each case: prefixes and assertions, machine against hand-written.

    The sections of a case are few and named, so a conditional aggregate lines
    them up in one shuffle.  Sections that a case has several times are lined up
    first with first, second with second; ``turn`` counts them from 1.
    """
    same = Window.partitionBy("bug_project", "bug_id", "section").orderBy("seq", "body")
    sections = sections.withColumn("turn", F.row_number().over(same))

    def body(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == name, F.col("body"))), F.lit(""))

    lined = sections.groupBy("bug_project", "bug_id", "turn").agg(
        body("evosuite_prefix").alias("ep"), body("regression_oracle").alias("ro"),
        body("dev_prefix").alias("dp"), body("dev_assertion").alias("da"),
        body("true_assertion").alias("ta"),
    )
    return lined.select(
        "bug_project", "bug_id", "turn",
        F.levenshtein("ep", "dp").alias("prefix_distance"),
        F.levenshtein("ro", "da").alias("assertion_distance"),
        F.levenshtein("ro", "ta").alias("oracle_distance"),
    )
