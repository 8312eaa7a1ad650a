import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm.common import id_remainder
from proofmill.llm.toxicity import SIZES, Bags, Model, fit, score

SF = "/root/testdata/sf0.1"  # sf0.01 has 35 toxic texts to learn ten words in four languages from


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return fit(docs.filter(id_remainder(F.col("doc_id"), 4) != 2), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(id_remainder(F.col("doc_id"), 4) == 2)
    rows = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("toxic", score(F.col("text"), model).alias("s")).collect()
    toxic, clean = [r["s"] for r in rows if r["toxic"]], [r["s"] for r in rows if not r["toxic"]]
    assert np.mean([t > c for t in toxic for c in clean]) >= 0.95
    assert np.mean([s >= 0.3 for s in clean]) <= 0.1 and np.mean([s >= 0.3 for s in toxic]) >= 0.8


def test_misspelling_shares_n_grams(spark, model):
    texts = [("the idiot here",), ("the idiott here",), ("IDIOT",), ("the ound here",), (None,), ("",), ("?!",), ("on the " * 50_000 + "idiot",)]
    got = [r["s"] for r in spark.createDataFrame(texts, "text string").select(score(F.col("text"), model).alias("s")).collect()]
    assert min(got[:3] + got[7:]) >= 0.3 > got[3]
    assert got[4] == got[5] == got[6] == 0.0


def test_bags_hold_every_n_gram_once():
    bags = Bags(19)
    weights = np.random.default_rng(0).random(1 << 19).astype(np.float32)
    text = "Abc de-f 12x, ünter!"
    bags.read([text])
    got = bags.words(weights)
    words = re.findall(r"[^\W_]+", text.lower())
    assert len(got) == len(words)
    counts = np.bincount(np.searchsorted(bags.start, np.concatenate([at for at, _ in bags.grams()]), side="right") - 1)
    assert counts.tolist() == [1 + sum(max(0, len(w) + 2 - n + 1) for n in SIZES) for w in words]
    for k, w in enumerate(words):  # a word scores the same wherever it stands
        bags.read([w])
        assert bags.words(weights)[0] == pytest.approx(got[k], rel=1e-5)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, None), (None, 1)], [(9, 1), (8, 0)]):
        model = fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert model.weights is None
        assert [r["s"] for r in docs.select(score(F.col("text"), model).alias("s")).collect()] == [0.0, 0.0]
    assert docs.limit(0).select(score(F.col("text"), Model(None, 0.0)).alias("s")).collect() == []


def test_repeated_labels_and_rows(spark):
    docs = spark.createDataFrame([(k % 40, f"word{k % 40} " + ("bad" if k % 2 else "good"), 0) for k in range(80)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 0) for k in range(40)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = {r["text"]: r["s"] for r in docs.select("text", score(F.col("text"), model).alias("s")).collect()}
    assert min(s for t, s in got.items() if "bad" in t) > max(s for t, s in got.items() if "good" in t)


def slow_score(text: str | None, model: Model, bits: int) -> float:
    """The worst word's chance, n-gram by n-gram, in whole numbers modulo 2**64."""

    def bucket(h: int) -> int:
        return ((h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64) >> 64 - bits

    worst = None
    for word in "".join(c.lower() if c.isalpha() or c.isdigit() else " " for c in text or "").split():
        marked = [0, *map(ord, word), 0]
        bag = [bucket((sum(c * 0x5851F42D4C957F2D**k for k, c in enumerate(marked)) + 97) % 2**64)]
        for n in SIZES:
            for at in range(len(marked) - n + 1):
                h = 0
                for k, c in enumerate(marked[at : at + n]):
                    h = (h * 0x100000001B3 + c + k + 1) % 2**64
                bag.append(bucket(h))
        z = float(np.mean(model.weights[bag].astype(float))) + model.bias
        worst = z if worst is None else max(worst, z)
    return 0.0 if worst is None else 1 / (1 + np.exp(-worst))


def test_score_against_brute_force(spark):
    bits = 12
    model = Model(np.random.default_rng(2).normal(0, 4, 1 << bits).astype(np.float32), -1.5)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(40).collect()]
    texts = [t[:3000] for t in texts] + [None, "", "?! -", "a", "über-Fuß 12x", "x" * 500, "中文 字"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", score(F.col("text"), model).alias("s")).collect():
        assert r["s"] == pytest.approx(slow_score(texts[r["i"]], model, bits), abs=1e-4)


def test_sample_is_bounded(spark):
    """Repeated ids give one text to learn from, and very long texts none; all are scored."""
    rows = [(1, "bad word")] * 200 + [(2, "good word")] * 200 + [(3, "bad " * 2000), (4, "good thing"), (None, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    model = fit(docs, labels, longest=100)
    got = {r["text"]: r["s"] for r in docs.select("text", score(F.col("text"), model).alias("s")).collect()}
    assert got["bad " * 2000] == pytest.approx(got["bad"]) and got["bad word"] > got["good word"]
