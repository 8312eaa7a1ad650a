"""N-gram Jaccard join: a size-aware join of small and large sets, down to components.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 75 % or more.

1. Every text is read once for its set's size and identity. Equal sets go on as one.
2. Sets up to a boundary are small. Two small sets of n and m shingles link exactly if they share a subset
   of t = ceil(75 (n + m) / 175) shingles, so each enumerates its subsets of every size t that it may
   need, and those with a key in common link without a further look.
3. Larger sets, and small ones near enough in size to link with them, go into inverted lists. Only the
   first n - ceil(0.75 n) + 1 shingles of a set need listing, in any order that all sets keep: shingles
   seen to be frequent come last, in order of frequency, so lists stay short.
4. A list is scanned for its first member (the one with the fewest shingles before this one) and links of others to
   it. Candidates pass a bitmap each set has: where two bitmaps differ in more places than the sets may
   differ in shingles, they cannot link. The rest is verified on whole sets. What a component already holds
   together needs no more pairs. Lists that still hold several components are scanned for pairs across them, which are verified.

The boundary is where the cost of enumerating, the number of subsets, passes that of listing, the number of
listed shingles times the price of a listing with its share of verification.

Frequent shingles are found by counting within a task and adding up. Their number is bounded by ``FREQUENT``;
this and the counting change the order of shingles, never the result. Lists of a frequent shingle
are not gathered: they are sorted runs, of which windows hold what fits in memory.

A text without words, and a null text, has an empty set and links with nothing. A text of one to four words has
one shingle, the whole of it. Repeated rows are equal sets. Rows with a null id link like others; their
component's id is null if no row of it has an id. Sets are compared by 64-bit hashes of shingles, and told apart by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import id_filter, small_batches, steps
from proofmill.llm.graph import components
from proofmill.llm.shingles import mixed, shingle_sets
from proofmill.session import written_once

PERCENT = 75
#: Shingles whose frequency orders them, at most, and the count that makes one frequent.
FREQUENT, OFTEN = 1_000_000, 8
#: Shingles counted together in a task, and the count within them that is passed on.
COUNTED, PASSED_ON = 6_000_000, 2
#: Price of a listed shingle in enumerated subsets; sizes that may be small.
LISTING, SMALL_SIZES = 4, 12
#: Bits of a set's bitmap: each is the parity of the shingles that fall to it.
BITMAP = 2048


def needed(n: int, m: int, percent: int) -> int:
    """Common shingles that sets of n and m need."""
    return -(-percent * (n + m) // (100 + percent))


def subsets(n: int, percent: int) -> int:
    least = -(-percent * n // 100)
    return sum(comb(n, t) for t in range(least, n + 1))


def listed(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that is cheaper enumerated than listed, over all sizes up to it together."""
    cost, best, at = 0, 0, 0
    for n in range(1, SMALL_SIZES + 1):
        cost += sizes.get(n, 0) * (subsets(n, percent) - LISTING * listed(n, percent))
        if cost < best:
            best, at = cost, n
    return at


def identity(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    size = np.array([len(shingles)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(mixed(shingles).sum(keepdims=True) + size).view(np.int64)[0])


def bitmap(shingles: np.ndarray) -> bytes:
    at = (shingles & np.uint64(BITMAP - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITMAP) & 1).tobytes()


def read_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, place, sid, n, bits`` of each text (no sid without words); where ``doc`` is false, a shingle as sid and its count in a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            shingle, count = np.unique(np.concatenate(held), return_counts=True)
            shingle, count = shingle[count >= PASSED_ON], count[count >= PASSED_ON]
            none = [None] * len(shingle)
            return rows([False] * len(shingle), none, none, shingle.view(np.int64), count, none)

        def rows(*columns) -> pa.RecordBatch:
            types = (pa.bool_(), *[pa.int64()] * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "doc_id", "place", "sid", "n", "bits"])

        for batch in batches:
            ids, places, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, run in steps(batch.column(1).to_pylist()):
                for k, s in enumerate(shingle_sets(run)):
                    out.append((ids[first + k], places[first + k], identity(s) if len(s) else None, len(s), bitmap(s)))
                    if len(s):
                        held.append(s)
                        size += len(s)
                        if size > COUNTED:
                            yield counts()
                            held, size = [], 0
            if out:
                yield rows([True] * len(out), *zip(*out))
        if held:
            yield counts()

    return docs.mapInArrow(scan, "doc boolean, doc_id long, place long, sid long, n long, bits binary")


def list_sets(docs: DataFrame, frequent: dict[str, np.ndarray], small: int, percent: int) -> DataFrame:
    """``tok, sid, n, e``: listed shingles with the number of shingles from there on; for subsets e is minus their size."""
    values, ranks = frequent["shingle"], frequent["rank"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << 20, bool)
        there[values >> np.uint64(44)] = True
        seen: set[int] = set()
        for batch in batches:
            toks, sids, sizes, rests = [], [], [], []
            for _, run in steps(batch.column(0).to_pylist()):
                for s in shingle_sets(run):
                    n = len(s)
                    if not n:
                        continue
                    sid = identity(s)
                    if sid in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sid)
                    if n <= small:
                        for t in range(-(-percent * n // 100), n + 1):
                            keys = np.array([mixed(s[list(c)]).sum() for c in combinations(range(n), t)])
                            toks.append(mixed(keys + np.uint64(t)))
                            rests.append(np.full(len(keys), -t))
                            sids.append(np.full(len(keys), sid))
                            sizes.append(np.full(len(keys), n))
                    if 100 * n >= percent * (small + 1):
                        p = listed(n, percent)
                        maybe = there[s >> np.uint64(44)]
                        light = s[~maybe]
                        if maybe.any():
                            candidates = s[maybe]
                            at = np.minimum(np.searchsorted(values, candidates), len(values) - 1)
                            heavy = values[at] == candidates
                            light = np.sort(np.concatenate([light, candidates[~heavy]]))
                            s = np.concatenate([light, candidates[heavy][np.argsort(ranks[at[heavy]])]])
                        toks.append(s[:p])
                        rests.append(np.arange(n, n - p, -1))
                        sids.append(np.full(p, sid))
                        sizes.append(np.full(p, n))
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).view(np.int64)) for c in (toks, sids, sizes, rests)], ["tok", "sid", "n", "e"]
                )

    return docs.select("text").mapInArrow(scan, "tok long, sid long, n long, e long")


def whole_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``sid, set`` (packed hashes) for the documents of ``sid, doc_id, place``; a repeated document comes as often.

    Only documents that may be asked for are read into sets; the join makes it exact.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, run in steps(batch.column(1).to_pylist()) for s in shingle_sets(run)]
            sids = pa.array([identity(s) if len(s) else None for s in sets], pa.int64())
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sids, packed], ["doc_id", "place", "sid", "set"])

    may = id_filter(asked.select("doc_id").filter("doc_id IS NOT NULL"))(F.col("doc_id"))
    without_id = asked.filter("doc_id IS NULL").select("place")
    if not without_id.isEmpty():
        may = may | id_filter(without_id)(F.col("place"))
    found = docs.filter(may).mapInArrow(scan, "doc_id long, place long, sid long, set binary")
    keys = asked.select("sid", F.col("doc_id").alias("_id"), F.col("place").alias("_place"))
    same = (F.col("doc_id") == F.col("_id")) | (F.col("_id").isNull() & F.col("doc_id").isNull() & (F.col("place") == F.col("_place")))
    return found.join(keys, "sid").filter(same).select("sid", "set")


def both_ends(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with the columns of ``sid, ...`` for either end, named after it."""
    for end in "ab":
        pairs = pairs.join(of.select(*[F.col(c).alias(end if c == "sid" else f"{c}_{end}") for c in of.columns]), end)
    return pairs


def possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow a link."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        both = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), BITMAP // 8) for c in (x, y)]
        differ = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
        size = n.to_numpy() + m.to_numpy()
        need = -(-percent * size // (100 + percent))
        return pa.array(differ <= size - 2 * need)

    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    of = facts.select("sid", "n", "bits").join(ends, "sid").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    return both_ends(pairs, of).filter(near("bits_a", "bits_b", "n_a", "n_b")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, keepers: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    asked = written_once(ends.join(keepers, "sid"), "asked")
    sets = written_once(whole_sets(docs, asked), "whole")
    if sets.count() > asked.count():  # repeated rows
        sets = sets.groupBy("sid").agg(F.first("set").alias("set"))

    @F.arrow_udf("boolean")
    def link(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(a) + len(b) - len(np.union1d(a, b))
            out.append((100 + percent) * both >= percent * (len(a) + len(b)))
        return pa.array(out)

    return both_ends(pairs, sets).filter(link("set_a", "set_b")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows without an id are found again by their text
    docs = docs.withColumn("place", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    read = written_once(read_sets(docs), "sets")
    facts = read.filter("doc")
    counted = read.filter("NOT doc").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    top = counted.orderBy(F.desc("n"), "sid").limit(FREQUENT).toArrow()
    shingle, count = top.column("sid").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(shingle)
    rank = np.empty(len(shingle), np.int32)
    rank[np.lexsort((shingle, count))] = np.arange(len(shingle))
    frequent = {"shingle": shingle[order], "rank": rank[order]} if len(shingle) else {"shingle": np.zeros(1, np.uint64), "rank": np.zeros(1, np.int32)}
    sizes = {r["n"]: r["k"] for r in facts.filter(F.col("n") <= SMALL_SIZES).groupBy("n").agg(F.count_distinct("sid").alias("k")).collect()}
    small = boundary(sizes, percent)

    def enough(common: Column, n: Column | str, m: Column | str) -> Column:
        return (100 + percent) * common >= percent * (F.col(n) + F.col(m))

    # lists of one set, and sets that no other of their list can link with, are left out as the lists are made
    whole = Window.partitionBy("tok")
    lists = list_sets(docs, frequent, small, percent)
    lists = (
        lists.withColumn("least", F.min("n").over(whole)).withColumn("lo", F.min("sid").over(whole)).withColumn("hi", F.max("sid").over(whole))
        .filter("lo <> hi").filter((F.col("e") < 0) | enough(F.col("e"), "n", "least"))
    )
    lists = written_once(lists.select("tok", "sid", "n", "e").distinct(), "lists")

    # subsets: the smallest set of a key links with every set that any of them links with
    first = Window.partitionBy("tok").orderBy("n", "sid")
    enumerated = lists.filter("e < 0")
    enumerated = enumerated.withColumn("h", F.first(F.struct("n", "sid")).over(first))
    sure = enumerated.filter(enough(-F.col("e"), "n", "h.n") & (F.col("sid") != F.col("h.sid")))
    sure = sure.select(F.col("h.sid").alias("a"), F.col("sid").alias("b")).distinct()

    scanned = lists.filter("e > 0")
    ahead = Window.partitionBy("tok").orderBy(F.col("n") - F.col("e"), "n", "sid")
    stars = scanned.withColumn("h", F.first(F.struct("n", "sid", "e")).over(ahead))
    may = enough(F.least("e", "h.e"), "n", "h.n") & (F.greatest("n", "h.n") > small) & (F.col("sid") != F.col("h.sid"))
    stars = written_once(stars.filter(may).select(F.least("sid", "h.sid").alias("a"), F.greatest("sid", "h.sid").alias("b")).distinct(), "stars")

    keepers = facts.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"))
    likely = written_once(possible(stars, facts, percent), "likely")
    links = written_once(sure.unionByName(verified(likely, docs, keepers, percent)), "links")
    labels = components(links)

    # what is left: lists that still hold several components
    held = scanned.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_ = held.withColumn("lo", F.min("label").over(whole)).withColumn("hi", F.max("label").over(whole)).filter("lo <> hi").select("tok", "sid", "n", "e", "label")
    open_ = written_once(open_, "open")
    left, right = (open_.select("tok", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "e", "label")]) for x in "ab")
    across = left.join(right, "tok").filter(
        (F.col("label_a") != F.col("label_b")) & (F.col("sid_a") < F.col("sid_b")) & (F.greatest("n_a", "n_b") > small)
        & enough(F.least("e_a", "e_b"), "n_a", "n_b")
    ).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    across = written_once(possible(across, facts, percent), "across")
    if not across.isEmpty():
        more = verified(across, docs, keepers, percent)
        labels = components(links.unionByName(more))

    named = keepers.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("sid", "component_id")
    rows = facts.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))
