from pyspark.sql import functions as F

from proofmill.llm.common import id_filter, steps


def test_filter_misses_none(spark):
    ids = spark.range(0, 40_000, 7).withColumnRenamed("id", "doc_id")
    maybe = id_filter(ids.unionByName(spark.createDataFrame([(None,), (-5,)], "doc_id long")))
    every = spark.range(-10, 60_000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    passed = {r["doc_id"] for r in every.filter(maybe(F.col("doc_id"))).collect()}
    wanted = {r["doc_id"] for r in ids.collect()} | {-5}
    assert wanted <= passed and None not in passed and len(passed) < len(wanted) + 8000


def test_filter_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert spark.range(5).filter(id_filter(none)(F.col("id"))).collect() == []


def test_steps_hold_every_text():
    texts = ["a" * 300_000, None, "b" * 500_000, "", "c"] + ["d"] * 700
    assert [t for first, run in steps(texts) for t in run] == [t or "" for t in texts]
    assert [first for first, _ in steps(texts)] == [0, 2, 3, 259, 515]
