"""Exact top-k inner products by aggregation without random access.

A block of candidates is kept as one list for each dimension, sorted by that component. For a query a
list is read from the end where it adds most: from above for a positive component of the query, from
below for a negative one. Every candidate has a lower bound (what has been read of it, and the least that each
other list can add) and an upper bound (and at most the last value read of each other list). Reading goes on,
in lockstep, until no candidate outside those whose upper bound reaches the k-th lower bound can qualify,
not even one never seen; what is left is resolved to final scores. A task takes its candidates block by
block, and the k-th score so far is a lower bound from the start for all blocks after the first: the next step
then goes at once to the depth where the last values read no longer add up to it.

Queries and candidates meet in a grid of blocks of bounded size, one task's work each; the k best of the
blocks then meet for each query. That is the stated query set against all rows, in blocks. What moves is a copy of each
candidate for every ``QUERIES`` queries and one of each query for every ``CANDIDATES`` candidates, in the narrowest type
that holds the components; of a query's own best only ids and scores move.

Rows whose vector is null or holds a null or non-finite component take no part. A candidate of the query's
own id is the query itself. Vectors meet those of their own length only; with length 0 all scores are
0. Repeated candidates all count, but no answer holds more than k copies of one, so no more are searched; a
repeated query is asked once. Ties go to the smaller id. Rows with a null id take no part. Components are whole numbers
whose products fit 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 16_384, 8192
#: Reading stops when one in so many candidates is left; resolving these then costs less than reading on.
RESOLVED = 8
#: Depths at which reading may stop, and candidates that are read together.
GRID, BLOCK = 16, 4096


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component, or null for a vector that takes no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def narrow(vector: str, largest: int | None) -> Column:
    """The vector in the narrowest type for components up to ``largest``."""
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 64)) if (largest or 0) < 1 << bits)
    return F.col(vector).cast(f"array<{kind}>")


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], np.ascontiguousarray(vectors[by_id])
        columns = np.ascontiguousarray(self.vectors.T)
        up = np.argsort(columns, axis=1, kind="stable")
        values = np.take_along_axis(columns, up, axis=1)
        self.up = list(zip(up, values))
        self.down = list(zip(np.ascontiguousarray(up[:, ::-1]), np.ascontiguousarray(values[:, ::-1])))

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score and then id; those below ``floor`` may be missing."""
        n, dims = len(self.ids), np.flatnonzero(query)
        alive = self.ids != own
        k = min(k, int(alive.sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        lists = [self.up[d] if query[d] < 0 else self.down[d] for d in dims]  # each from its best end
        weight = query[dims]
        least = np.array([values[-1] for _, values in lists], np.int64)
        lower = np.full(n, (least * weight).sum())
        unread = np.ones((len(dims), n), np.float32)
        left, depth, kth = np.flatnonzero(alive), 0, floor
        grid = np.unique(np.linspace(0, n, GRID + 1).astype(int))[1:]
        ahead = np.stack([values[grid - 1] for _, values in lists]) * weight[:, None] if lists else np.zeros((0, len(grid)))
        ahead = ahead.sum(axis=0)  # the most that a candidate can have which no list has shown by then
        while depth < n and len(lists) and len(left) > max(k, n // RESOLVED):
            later = grid > depth
            enough = later & (ahead < kth) if kth is not None else grid >= 2 * depth
            upto = int(grid[np.argmax(enough)]) if enough.any() else n
            if not later[np.searchsorted(grid, upto)]:
                upto = int(grid[np.argmax(later)])
            gap = np.empty(len(lists), np.float32)
            for j, (rows, values) in enumerate(lists):
                rows, values = rows[depth:upto], values[depth:upto]
                # a list has each candidate once
                lower[rows] += (values - least[j]) * weight[j]
                unread[j][rows] = 0
                gap[j] = (values[-1] - least[j]) * weight[j]
            depth = upto
            worst = np.partition(lower[left], len(left) - k)[len(left) - k]
            kth = worst if kth is None else max(kth, worst)
            # rounded up, so that an upper bound is never too small
            upper = lower[left] + np.ceil((gap @ unread)[left] * (1 + 1e-4)).astype(np.int64) + 1
            left = left[upper >= kth]
        scores = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES, asked: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` from frames of ``id`` (long) and ``v`` (array of long, not null)."""
    vectors = vectors.filter("id IS NOT NULL")
    number, largest = vectors.agg(F.count("*"), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    queries = queries.filter("id IS NOT NULL")
    asks, largest_asked = queries.agg(F.count("*"), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    rows, columns = math.ceil(number / candidates) or 1, math.ceil(asks / asked) or 1
    vectors = vectors.groupBy("id", narrow("v", largest).alias("v")).agg(F.count("*").alias("n"))
    vectors = vectors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    queries = queries.select(F.col("id").alias("q"), narrow("v", largest_asked).alias("w")).distinct()

    def part(n: int, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.select(F.size("v").alias("d"), "id", "v", part(rows, "id", "v", "copy").alias("r")).select("*", every(columns).alias("c"))
    right = queries.select(F.size("w").alias("e"), "q", "w", F.xxhash64("w").alias("h"), part(columns, "q", "w").alias("y")).select("*", every(rows).alias("x"))

    def block(them: pa.Table, asks: pa.Table) -> pa.Table:
        def matrix(t: pa.Table, name: str) -> np.ndarray:
            return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)

        found: list[tuple[np.ndarray, ...]] = []
        if len(them) and len(asks):
            d = them.column("d")[0].as_py()
            ids, vs = them.column("id").to_numpy(), matrix(them, "v").reshape(len(them), d)
            blocks = [Lists(ids[at : at + BLOCK], vs[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
            for own, h, query in zip(asks.column("q").to_pylist(), asks.column("h").to_pylist(), matrix(asks, "w").reshape(len(asks), d)):
                best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for lists in blocks:
                    more = lists.top(own, query, k, int(scores[-1]) if len(scores) == k else None)
                    best, scores = np.concatenate([best, more[0]]), np.concatenate([scores, more[1]])
                    order = np.lexsort((best, -scores))[:k]
                    best, scores = best[order], scores[order]
                found.append((np.full(len(best), own), np.full(len(best), h), best, scores))
        q, h, i, s = (np.concatenate(x).astype(np.int64) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))
        return pa.table({"query_id": q, "h": h, "vec_id": i, "score": s})

    parts = left.groupBy("d", "r", "c").cogroup(right.groupBy("e", "x", "y")).applyInArrow(block, "query_id long, h long, vec_id long, score long")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
