"""Positional pairing of the two halves of a corpus, and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_by_position(
    assertions: DataFrame, prefixes: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join line k of one side to line k of the other within each project."""
    return assertions.join(prefixes, keys, how)


def alignment_audit(assertions: DataFrame, prefixes: DataFrame, project: str, line: str) -> DataFrame:
    """Per project: lines on each side, matched positions, and whether the sides align.

    Both sides are stacked and counted per position, then per project, so that
    each count combines on the map side and a huge project is no burden.
    """
    sides = assertions.select(project, line, F.lit(1).alias("a"), F.lit(0).alias("p")).unionByName(
        prefixes.select(project, line, F.lit(0).alias("a"), F.lit(1).alias("p"))
    )
    positions = sides.groupBy(project, line).agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    return positions.groupBy(project).agg(
        F.sum("a").alias("n_assertions"),
        F.sum("p").alias("n_prefixes"),
        F.count_if((F.col("a") > 0) & (F.col("p") > 0)).alias("n_paired"),
        F.bool_and(F.col("a") == F.col("p")).alias("aligned"),
    )
