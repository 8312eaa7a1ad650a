"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a source are ranked in a seeded random order; row r of n stands at (2r + 1) / 2n of the way. All
rows are sorted by that fraction and the order is cut into shards, so every shard, and every stretch of
a shard, holds the sources in the proportions of the whole. Shards differ by one row at most.

No window spans a source or the table: ranks come from buckets (see ``prefix``), and the second order
is cut into spans of the fraction, each numbered by a window of its own and moved on by the rows of the
spans before it. Only ids, sources and what the caller asks for are shuffled, never texts.

A null source is a source of its own. Equal keys fall to the id (nulls first), then to ``ties``; rows
alike in all of them are interchangeable. Empty tables give no rows. Copies of a text are spread like
other rows: counts one apart and whole groups exclude each other once a group is larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.prefix import bucket_bits, running
from proofmill.session import written_once

LAW = "rows"


def interleave(
    rows: DataFrame, stratum: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), shards: int = 16, seed: int = 29
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0) to rows; let them be narrow."""
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    bits = bucket_bits(rows)
    spans = 1 << bits
    ranked = running(rows.select(*columns), stratum, key, list(ties), F.lit(1).cast("long"), seed, bits)
    ranked = written_once(
        ranked.withColumn("_place", (2 * F.col("_before") + 1) / (2 * F.col("_all")))
        .withColumn("_span", F.expr(f"(2 * _before + 1) * {spans}L div (2 * _all)")),
        "ranked",
    )
    # one row for each span, of which there are as many as buckets
    counts = ranked.groupBy("_span").agg(F.count("*").alias("_in"))
    edges = counts.select(
        "_span",
        F.coalesce(F.sum("_in").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_in").over(Window.partitionBy()).alias("_total"),
    )
    order = Window.partitionBy("_span").orderBy("_place", "_s", "_before")
    return (
        ranked.withColumn("_at", F.row_number().over(order) - 1).join(edges, "_span")
        .withColumn("_at", F.col("_at") + F.col("_from"))
        .withColumn("shard", F.expr(f"(_at * {shards}) div _total").cast("int"))
        .withColumn("slot", F.col("_at") - F.expr(f"(shard * _total + {shards - 1}) div {shards}"))
        .select(*columns, "shard", "slot")
    )
