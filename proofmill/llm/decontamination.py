"""Benchmark decontamination: short test items inside long documents.

An item is found in a document when the document holds at least 75 % of the item's distinct five-word
shingles. Whole-document resemblance says nothing about a short passage in a long text, so the search is
for containment: each item has a MinHash sketch, its K shingles of the smallest hashes, and a document
is a candidate for the item when it holds any of them. Items are partitioned by size, in powers of two, and K goes
with the partition: a quarter of its largest size, and one. A document that lacks a quarter of an item's shingles
at most cannot lack K of them, so no item is missed. Candidates are verified by exact containment.

Sketches are looked up in the pass that shingles the documents, so nothing is shuffled. Items are taken in
blocks of ``BLOCK`` shingles, which bounds what is broadcast; each further block is another pass.

An item of one to four words is one shingle, the whole of it, and is found where its words stand one after the other;
documents are cut into runs of so many words only if an item has that length. Such items are common words at times:
``shortest`` leaves out items of fewer words than it says. Null and empty texts hold nothing, and are no items. A repeated item counts once, a repeated document each time. Without items there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import WORD, small_batches, steps
from proofmill.llm.shingles import WIDTH, shingle_sets

BLOCK = 1_000_000
FILTER_BITS = 22


def sketch_size(n: int, percent: int) -> int:
    """K of the partition that holds items of n shingles."""
    largest = 1 << max(0, n - 1).bit_length()
    return largest * (100 - percent) // 100 + 1


class Items:
    """Sketches of one block of items, ready for lookup."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        ranked = [s[np.argsort(s * np.uint64(0x9E3779B97F4A7C15))][: sketch_size(len(s), percent)] for s in sets]
        values, owners = np.concatenate(ranked), np.repeat(np.arange(len(sets)), [len(r) for r in ranked])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.there = np.zeros(1 << FILTER_BITS, bool)
        self.there[self.values >> np.uint64(64 - FILTER_BITS)] = True

    def found_in(self, held: np.ndarray) -> Iterator[tuple[int, int]]:
        """Item and common shingles for each item that the sorted set holds."""
        maybe = held[self.there[held >> np.uint64(64 - FILTER_BITS)]]
        if not len(maybe):
            return
        first, last = np.searchsorted(self.values, maybe), np.searchsorted(self.values, maybe, side="right")
        spans = [self.owners[a:b] for a, b in zip(first.tolist(), last.tolist()) if b > a]
        for item in np.unique(np.concatenate(spans)).tolist() if spans else ():
            own = self.sets[item]
            at = np.searchsorted(held, own)
            common = int((held[np.minimum(at, len(held) - 1)] == own).sum())
            if 100 * common >= self.percent * len(own):
                yield item, common


def blocks(
    items: DataFrame, key: str, text: str, block: int, shortest: int = 1
) -> Iterator[tuple[list[int | None], list[np.ndarray], tuple[int, ...]]]:
    """Ids and shingle sets of the distinct items, about ``block`` words at a time, and their lengths below five words."""
    size = F.regexp_count(F.col(text), F.lit(WORD))
    searched = items.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t"), size.alias("n")).filter(
        F.col("n") >= max(shortest, 1)
    ).distinct()
    words = searched.agg(F.sum("n").alias("n")).first()["n"] or 0
    number = -(-words // block)
    for part in range(number):
        rows = searched.filter(F.pmod(F.xxhash64("t"), F.lit(number)) == part).collect()
        if rows:
            sets = [s for at in range(0, len(rows), 1000) for s in shingle_sets([r["t"] for r in rows[at : at + 1000]])]
            yield [r["i"] for r in rows], sets, tuple(sorted({r["n"] for r in rows if r["n"] < WIDTH}))


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    percent: int = 75, block: int = BLOCK, shortest: int = 1,
) -> DataFrame:
    """``doc_id, item_id, n_item, n_common, containment``: one row for each document that holds an item."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, n_item long, n_common long"

    def search(ids: list[int | None], sets: list[np.ndarray], short: tuple[int, ...]) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(ids, sets, percent)
            for batch in batches:
                keys, out = batch.column(0).to_pylist(), []
                for first, run in steps(batch.column(1).to_pylist()):
                    for k, held in enumerate(shingle_sets(run, short)):
                        out += [(keys[first + k], known.ids[i], len(known.sets[i]), n) for i, n in known.found_in(held)]
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item", "n_common"])

        return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(scan, schema)

    found = [search(*b) for b in blocks(items, item_key, item_text, block, shortest)]
    found = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    percent: int = 75, block: int = BLOCK, shortest: int = 1,
) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)

    def holds(ids: list[int | None], sets: list[np.ndarray], short: tuple[int, ...]) -> Column:
        @F.arrow_udf("boolean")
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = Items(ids, sets, percent)
            for column in batches:
                yield pa.array([
                    any(True for _ in known.found_in(held))
                    for _, run in steps(column.to_pylist()) for held in shingle_sets(run, short)
                ], pa.bool_())

        return scan.asNondeterministic()(F.col(text))

    for b in blocks(items, item_key, item_text, block, shortest):
        docs = docs.filter(~holds(*b))
    return docs
