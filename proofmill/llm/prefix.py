"""Prefix sums in a seeded random order of each stratum, without a window over a stratum.

A stratum's rows are dealt into buckets by the leading bits of a random key. A window sums up within a
bucket, and a small table of bucket sums tells what lies before each bucket, so a stratum that holds a
third of all rows is spread over as many tasks as its buckets. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60
#: Rows of a bucket at most, on average over all strata.
BUCKET_ROWS = 50_000


def random_key(key: Column, seed: int) -> Column:
    """A random 60-bit number from the id and the seed, the same on every run and in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: DataFrame) -> int:
    """Bits that make buckets of BUCKET_ROWS at most, and as many buckets as there are shuffle partitions."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return math.ceil(math.log2(max(rows.count() / BUCKET_ROWS, tasks, 1)))


def running(rows: DataFrame, stratum: str, key: str, ties: list[str], value: Column, seed: int, bits: int,
            facts: DataFrame | None = None) -> DataFrame:
    """Add ``_h`` (random key), ``_s`` (stratum as a struct, so that null is one), ``_value``, ``_before``
    (values of the stratum's earlier rows) and ``_all`` (values of the stratum).

    ``facts`` has one row for each ``_s``; its columns reach the rows by way of the bucket sums.
    """
    keyed = (
        rows.withColumn("_h", random_key(F.col(key), seed)).withColumn("_s", F.struct(F.col(stratum).alias("of")))
        .withColumn("_b", F.shiftright("_h", KEY_BITS - bits)).withColumn("_value", value)
    )
    sums = keyed.groupBy("_s", "_b").agg(F.sum("_value").alias("_in"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "_s", "_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_begin"),
        F.sum("_in").over(Window.partitionBy("_s")).alias("_all"),
    )
    if facts is not None:
        sums = sums.join(facts, "_s")
    earlier = Window.partitionBy("_s", "_b").orderBy("_h", key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("_before", F.coalesce(F.sum("_value").over(earlier), F.lit(0)))
        .join(sums, ["_s", "_b"])
        .withColumn("_before", F.col("_before") + F.col("_begin"))
        .drop("_b", "_begin")
    )
