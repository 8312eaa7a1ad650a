"""Test outcomes on a buggy and a fixed version, and oracle changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_diff(outcomes: DataFrame) -> DataFrame:
    """outcomes(bug, version, test, passed) → one row per test with its class.

    Grouping with two conditional aggregates gives the full outer comparison in
    one shuffle.  A test passes on a version when all its runs there passed.
    """
    both = outcomes.groupBy("bug", "test").agg(
        F.bool_and(F.when(F.col("version") == "buggy", F.col("passed"))).alias("on_buggy"),
        F.bool_and(F.when(F.col("version") == "fixed", F.col("passed"))).alias("on_fixed"),
    )
    kind = (
        F.when(F.col("on_buggy").isNull(), "only_fixed")
        .when(F.col("on_fixed").isNull(), "only_buggy")
        .when(~F.col("on_buggy") & F.col("on_fixed"), "fails_then_passes")
        .when(F.col("on_buggy") & ~F.col("on_fixed"), "passes_then_fails")
        .when(F.col("on_buggy"), "passes_both")
        .otherwise("fails_both")
    )
    return both.withColumn("outcome", kind).withColumn(
        "differs", F.col("outcome").isin("fails_then_passes", "passes_then_fails")
    )


def apply_oracles(tests: DataFrame, replacements: DataFrame, keys: list[str]) -> DataFrame:
    """Put a supplied assertion in place of the old one, in the column and in the test text.

    tests carries text, assertion and assertion_at, the place of the assertion
    in the text; without that column the first place with the same words is
    taken. replacements carries keys and new_assertion. Of several
    replacements for one key the least, as text, counts.
    """
    given = replacements.groupBy(*keys).agg(F.min("new_assertion").alias("new_assertion"))
    joined = tests.join(given, keys, "left")
    at = F.col("assertion_at") if "assertion_at" in tests.columns else F.instr("text", F.col("assertion"))
    edited = F.concat(
        F.substring("text", F.lit(1), at - 1), F.col("new_assertion"),
        F.substring("text", at + F.length("assertion"), F.length("text")),
    )
    return joined.select(
        *keys,
        F.coalesce("new_assertion", "assertion").alias("assertion"),
        F.col("new_assertion").isNotNull().alias("replaced"),
        F.when(F.col("new_assertion").isNotNull(), edited).otherwise(F.col("text")).alias("text"),
    )


def drop_bad_prefixes(tests: DataFrame, bad: DataFrame) -> DataFrame:
    """Tests whose (bug_project, bug_id, test_no) is not on the tried-and-bad list.

    Both sides are shuffled: the list grows with the notes, and what is read out of their text is estimated far too
    small, so that it would be taken to the driver to be broadcast.
    """
    return tests.join(bad.hint("merge"), ["bug_project", "bug_id", "test_no"], "left_anti")
