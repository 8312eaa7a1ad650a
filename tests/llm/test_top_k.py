import numpy as np
from pyspark.sql import functions as F

from proofmill.llm import top_k as module
from proofmill.llm.top_k import Lists, quantized, top_k


def brute(ids, vectors, own, query, k):
    rest = [(-int(v @ query), i) for i, v in zip(ids.tolist(), vectors) if i != own]
    return [(i, -s) for s, i in sorted(rest)[:k]]


def test_lists_find_the_best_in_every_way_of_reading():
    rng = np.random.default_rng(3)
    for n, d, spread in ((1, 3, 9), (40, 4, 2), (300, 8, 1000), (257, 16, 1), (600, 2, 10**6)):
        vectors = rng.integers(-spread, spread + 1, (n, d))
        vectors[: n // 3] = vectors[0]
        ids = rng.permutation(n * 2)[:n]
        lists = Lists(ids, vectors)
        for q in range(0, n, max(1, n // 20)):
            best = brute(ids, vectors, ids[q], vectors[q], 10)
            got = lists.top(int(ids[q]), vectors[q], 10)
            assert list(zip(*map(np.ndarray.tolist, got))) == best
            if best:
                floor = best[-1][1]
                got = lists.top(int(ids[q]), vectors[q], 10, floor)
                assert list(zip(*map(np.ndarray.tolist, got))) == best
        zero = np.zeros(d, int)
        assert list(zip(*map(np.ndarray.tolist, lists.top(-1, zero, 3)))) == brute(ids, vectors, -1, zero, 3)


def test_grid_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (150, 5))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = top_k(df, df.filter("id % 7 = 0"), 4, candidates=40, asked=6).collect()
    want = [(q, r + 1, i, s) for q in range(0, 150, 7) for r, (i, s) in enumerate(brute(np.arange(150), vectors, q, vectors[q], 4))]
    assert sorted(map(tuple, got)) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.0009, -0.0009]), (6, [1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (0, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", quantized(F.col("e")).alias("v"))
    assert [r["v"] for r in df.filter("id = 5").collect()] == [[0, -1]]
    df = df.filter("v is not null")
    got = sorted(map(tuple, top_k(df, df.filter("id = 0")).collect()))
    assert got == [(0, 1, 7, 2 << 20), (0, 2, 7, 2 << 20), (0, 3, 5, -512)]
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_copies_types_and_null_ids(spark):
    """A candidate that comes very often is searched k times at most; wide components stay exact."""
    for big in (3, 40_000, 1 << 30):
        rows = [(1, [big, 1])] * 300 + [(2, [big, -1])] * 3 + [(3, [-big, 5]), (None, [big, big]), (4, []), (5, [1, 1, 1])]
        df = spark.createDataFrame(rows, "id long, v array<long>")
        got = sorted(map(tuple, top_k(df, df.filter("id in (2, 3)"), 5, candidates=8, asked=1).collect()))
        want = [(2, n + 1, 1, big * big - 1) for n in range(5)]
        want += [(3, n + 1, 1, 5 - big * big) for n in range(5)]
        assert got == want
