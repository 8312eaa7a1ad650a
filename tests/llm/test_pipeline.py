"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import pytest

from proofmill.session import written_once
from test_decontamination import sets
from test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written_once(stage(spark, docs, SF), "stage")
        out.append((name, before, docs))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_language_keeps_what_has_letters(steps):
    _, before, after = steps[0]
    assert ids(after) == Counter(r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"]))


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    groups = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == Counter({c for _, _, c in groups}) and after.count() < before.count()


def test_benchmark_goes(spark, steps):
    _, before, after = steps[2]
    items = [sets(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in before.collect() for i in items if i and 4 * len(i & sets(r["text"])) >= 3 * len(i)}
    assert ids(after) == Counter(set(ids(before)) - dirty)


def test_mix_takes_whole_texts_or_their_beginning(steps):
    _, before, after = steps[3]
    texts = {r["doc_id"]: (r["source"], r["text"]) for r in before.collect()}
    words, all_words = Counter(), 0
    for r in after.collect():
        assert texts[r["doc_id"]][1].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["source"]] += len(r["text"].split())
    all_words = sum(len(t.split()) for _, t in texts.values())
    assert abs(sum(words.values()) - 1.5 * all_words) <= len(words)
    assert max(ids(after).values()) <= 2


def test_shards(steps):
    _, before, after = steps[4]
    assert ids(after) == ids(before)
    sizes = Counter(r["shard"] for r in after.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_is_the_stages_in_order(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[-1][2].collect()))


def test_no_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
