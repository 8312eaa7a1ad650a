"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a budget of words, and its documents are taken in a seeded random order until the
budget is used up to the word: whole epochs first, then one more as far as the rest reaches, so the
last document may be taken in part. Sums before each document come from buckets of the random order
(see ``prefix``), so no task sees a whole source.

Budgets: sources, in order of code points with null last, weigh 5, 2, 1 and so on again, and share 1.5
times all words; no budget is above twice its source's words, and what would be above goes to the
others by weight. That is the level L at which the sum of min(2 * words, L * weight) is met, found by
one pass over the sources in the order of 2 * words / weight.

A document without words has size 0 and nothing is taken of it. Equal keys fall to the id (nulls
first), then to the size; rows alike in both share what is taken in either order. Without any word all
budgets are 0. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import WORD
from proofmill.llm.prefix import bucket_bits, running
from proofmill.session import written_once


def budgets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target of each source from its words: columns ``_s`` (struct), ``_all`` in; ``target`` (double) added.

    One row a source goes through a single window; documents do not.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_s.of").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_w", weight).withColumn("_cap", most * F.col("_all"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_s.of").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("_all").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after)
    # the level is that of the first source which it leaves below its cap
    levels = weighed.withColumn("_level", level).withColumn("_rank", rank)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))
    level = F.min(fits).over(whole).getField("_level")
    cap = F.col("_cap").cast("double")
    return levels.select("_s", F.coalesce(F.least(cap, level * F.col("_w")), cap).alias("target"))


def mix(rows: DataFrame, source: str = "source", key: str = "doc_id", size: str = "size", seed: int = 31) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to narrow rows that have a size in words."""
    columns = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    rows = written_once(rows.select(*columns), "sized")  # sizes are worked out once
    sizes = rows.groupBy(F.struct(F.col(source).alias("of")).alias("_s")).agg(F.sum(size).alias("_all"))
    joined = running(rows, source, key, [size], F.col(size), seed, bucket_bits(rows), budgets(sizes))
    joined = joined.withColumnRenamed("_all", "source_size")
    epochs = F.expr("CASE WHEN source_size = 0 THEN 0L ELSE cast(floor(target) AS long) div source_size END")
    rest = F.floor("target") - F.col("_epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col(size), F.col("_rest") - F.col("_before")))
    return (
        joined.withColumn("_epochs", epochs).withColumn("_rest", rest)
        .withColumn("taken", (F.col("_epochs") * F.col(size) + part).cast("long"))
        .select(*columns, "source_size", "target", "taken")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space kept."""
    space = WORD[2:-2]
    return F.array_join(F.slice(F.split(text, f"(?<=[^{space}])(?=[{space}])"), 1, n.cast("int")), "")


def take(docs: DataFrame, taken: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and once more cut to what is left.

    ``taken`` has the key, ``text_hash`` (xxhash64 of the text), ``size`` and ``taken``; rows alike in key and
    text are matched one to one. Columns stay as they are.
    """
    columns = docs.columns
    def numbered(df: DataFrame, names: list[str]) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*names)))

    left = numbered(docs.withColumn("_k", F.struct(key)).withColumn("_t", F.xxhash64(text)), ["_k", "_t"])
    right = numbered(taken.select(F.struct(key).alias("_k"), F.col("text_hash").alias("_t"), F.col("size").alias("_size"), F.col("taken").alias("_taken")), ["_k", "_t"])
    copies = left.join(right.filter("_taken > 0"), ["_k", "_t", "_n"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("(_taken + _size - 1) div _size"))))
    rest = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    cut = F.when(rest < F.col("_size"), first_words(F.col(text), rest)).otherwise(F.col(text))
    return copies.withColumn(text, cut).select(*columns)
