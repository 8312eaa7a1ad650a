"""Nearest-sample search against brute force."""

import random

from pyspark.sql import functions as F

from proofmill.operators import retrieval


def brute(queries, corpus):
    best = {}
    for q, qt in queries:
        for d, dt in corpus:
            a, b = set(qt.split()), set(dt.split())
            common, union = len(a & b), len(a | b)
            if common and (q not in best or (-common / union, d) < (-best[q][1] / best[q][2], best[q][0])):
                best[q] = (d, common, union)
    return best


def test_exact_on_skewed_words(spark):
    rng = random.Random(3)
    words = ["the"] * 300 + ["and"] * 100 + [f"w{i}" for i in range(200)]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(400)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(60)]
    queries += [(100, "the"), (101, "absent words"), (102, "the and"), (103, corpus[7][1])]
    got = retrieval.retrieve_nearest(
        spark.createDataFrame(queries, "query_id long, text string"),
        spark.createDataFrame(corpus, "corpus_id long, text string"),
    )
    found = {r.query_id: (r.corpus_id, r.n_common, r.n_union) for r in got.collect()}
    assert found.pop(101) == (None, None, None)
    assert found == brute(queries, corpus)


def test_one_token_in_all_of_them(spark):
    corpus = [(i, f"the w{i % 50} v{i}") for i in range(500)]
    queries = [(i, f"the w{i % 50} u{i}") for i in range(200)]
    got = retrieval.retrieve_nearest(
        spark.createDataFrame(queries, "query_id long, text string"),
        spark.createDataFrame(corpus, "corpus_id long, text string"),
    )
    assert {r.query_id: (r.corpus_id, r.n_common, r.n_union) for r in got.collect()} == brute(queries, corpus)


def test_similarity_column(spark):
    q = spark.createDataFrame([(1, "a b c")], "query_id long, text string")
    d = spark.createDataFrame([(5, "a b d")], "corpus_id long, text string")
    row = retrieval.retrieve_nearest(q, d).select(F.col("similarity")).first()
    assert row.similarity == 0.5


def test_few_candidates_with_a_token_in_every_text(spark):
    """Bounds keep the pairs far below queries times documents, and lose none."""
    corpus = [(i, f"the of w{i % 50} v{i}" + " x" * (i % 3)) for i in range(600)]
    queries = [(i, f"the of w{i % 50} u{i}") for i in range(200)] + [(900, "the"), (901, "of the")]
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "corpus_id long, text string")
    seen = []
    before = retrieval._candidates
    try:
        retrieval._candidates = lambda *frames: seen.append(before(*frames)) or seen[-1]
        got = {r.query_id: (r.corpus_id, r.n_common, r.n_union) for r in retrieval.retrieve_nearest(q, d).collect()}
    finally:
        retrieval._candidates = before
    assert got == brute(queries, corpus)
    assert seen[0].filter("query_id < 900").count() <= len(queries) * len(corpus) / 20


def test_bounds_from_a_sample_of_a_hot_token_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SEED_DOCS", 2)
    rng = random.Random(8)
    words = ["the"] * 200 + ["of"] * 150 + [f"w{i}" for i in range(30)]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(i, None) for i in (700, 701)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(80)] + [(95, None), (96, "")]
    got = retrieval.retrieve_nearest(
        spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "corpus_id long, text string")
    )
    found = {r.query_id: (r.corpus_id, r.n_common, r.n_union) for r in got.collect()}
    assert found.pop(95) == found.pop(96) == (None, None, None)
    assert found == brute([(i, t or "") for i, t in queries], [(i, t or "") for i, t in corpus])
