"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections may use freely.

    The optimizer moves filters below projections and repeats the expression
    there.  It does not do so across a generator, so the value goes through a
    one-element explode, which stays inside whole-stage code generation.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def exploded(df: DataFrame, value: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per entry of a computed array, optionally with its position.

    A plain explode lets the optimizer infer a size filter and push it down,
    where the whole array would be worked out a second time.
    """
    entries = computed_once(df, "_entries", value)
    row = F.explode("_entries").alias(name) if position is None else F.posexplode(
        "_entries"
    ).alias(position, name)
    return entries.select(*df.columns, row)


#: Rows that ask for one key from which on the key is hot, and the hot keys looked after at most: any other key
#: has fewer rows than that, or less than its share of all rows.
HOT_ROWS, HOT_KEYS = 10_000, 1000


def join_spread(asked: DataFrame, known: DataFrame, key: str, row: str, how: str = "left") -> DataFrame:
    """Join many askers to few answers, the askers of a hot key dealt over all tasks.

    Askers are counted by key, which combines on the map side. The few hot keys are broadcast, at most
    ``HOT_KEYS`` of them; their askers get a salt from the column ``row``, and their answers a copy for each salt. All
    other rows are joined as they are.
    """
    salts = 8 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # several to a task, as they fall by chance
    counted = asked.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = F.broadcast(counted.orderBy(F.desc("_n")).limit(HOT_KEYS).select(key, F.lit(True).alias("_hot")))
    none = F.lit(0)
    dealt = asked.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(none)
    ).drop("_hot")
    many = known.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(none, F.lit(salts - 1))).otherwise(F.array(none)))
    ).drop("_hot")
    return dealt.join(many, [key, "_salt"], how).drop("_salt")
