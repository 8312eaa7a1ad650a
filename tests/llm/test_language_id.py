from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from proofmill.llm.common import id_remainder
from proofmill.llm.language_id import Encoder, Profiles, fit_profiles, identify

SF = "/root/testdata/sf0.01"


def slow_bundle(text: str, encode: Encoder) -> np.ndarray:
    """The sum of n-gram vectors, one n-gram after the other."""
    total = np.zeros(encode.dimension)
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    for gram, n in Counter(g for w in words for g in zip(f"\0{w}\0", f"\0{w}\0"[1:], f"\0{w}\0"[2:])).items():
        base = [np.roll(encode.letter(ord(c))[-1], 2 - k) for k, c in enumerate(gram)]
        total += n * base[0].astype(int) * base[1] * base[2]
    return total


def test_bundles_are_sums_of_bound_letters():
    encode = Encoder(128, 1, 3)
    texts = ["Ab c, ábc!", "", "42 ...", "x", "the\nthe the Über", "中文字 و"]
    for got, text in zip(encode(texts), texts):
        assert (got == slow_bundle(text, encode)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = id_remainder(F.col("doc_id"), 5) == 0
    profiles = fit_profiles(docs.filter(~out))
    rows = (
        docs.filter(out).select(F.col("lang").alias("l"), identify(F.col("text"), profiles).alias("o"))
        .select("l", "o.lang").collect()
    )
    assert sum(r["l"] == r["lang"] for r in rows) >= 0.97 * len(rows) > 100


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "die katze und der hund", "de", 1.0), (2, "the cat and the dog", "en", 2.0), (3, None, "en", 3.0), (4, "", None, 4.0),
         (5, "123 !?", "en", 5.0), (None, "the dog", None, 6.0), (5, "the cat", "en", 5.0), (5, "the cat", "en", 5.0), (6, "the dog " * 100_000, None, 0.0)],
        "doc_id long, text string, lang string, score double",
    )
    profiles = fit_profiles(docs)
    assert profiles.languages == ["de", "en"]
    rows = [(r["doc_id"], r["score"], r["o"]) for r in docs.withColumn("o", identify(F.col("text"), profiles)).collect()]
    by_id = {i: o for i, _, o in rows}
    assert [by_id[k]["lang"] for k in (1, 2, 3, 4, None, 6)] == ["de", "en", "und", "und", "en", "en"]
    assert all(0 <= o["score"] <= 1 for _, _, o in rows) and by_id[3]["score"] == 0
    assert sorted(s for _, s, _ in rows) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0, 6.0]


def test_ties_and_nothing_to_learn(spark):
    same = np.ones((2, 16)) / 4
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert docs.select(identify(F.col("text"), Profiles(["aa", "bb"], same, 1, 3)).alias("o")).first()["o"]["lang"] == "aa"
    none = fit_profiles(docs)
    assert none.languages == []
    assert docs.select(identify(F.col("text"), none).alias("o")).first()["o"].asDict() == {"lang": "und", "score": 0.0, "margin": 0.0}
    assert docs.limit(0).select(identify(F.col("text"), none).alias("o")).collect() == []


def test_identify_against_brute_force(spark):
    """Profiles, cosine, choice and margin, one text and one language after the other."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(900, None, "xx"), (901, "", None), (902, "12 3", "xx"), (903, "中文 字中", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = fit_profiles(docs, dimension=64)
    encode = Encoder(64, profiles.seed, profiles.order)
    bundles = {i: slow_bundle(t or "", encode) for i, t, _ in rows}
    sums = {}
    for i, _, lang in rows:
        if lang is not None and bundles[i].any():
            sums[lang] = sums.get(lang, 0) + bundles[i] / np.linalg.norm(bundles[i])
    assert profiles.languages == sorted(sums)
    for r in docs.select("doc_id", identify(F.col("text"), profiles).alias("o")).collect():
        b, o = bundles[r["doc_id"]], r["o"]
        if not b.any():
            assert (o["lang"], o["score"], o["margin"]) == ("und", 0.0, 0.0)
            continue
        cosine = sorted(((b @ v / np.linalg.norm(b) / np.linalg.norm(v), x) for x, v in sums.items()), reverse=True)
        assert abs(o["score"] - min(1, max(0, cosine[0][0]))) < 1e-5
        assert abs(o["margin"] - (cosine[0][0] - cosine[1][0])) < 1e-5
        assert o["lang"] == cosine[0][1] or o["margin"] < 1e-5


def test_many_letters_are_counted_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(0x4E00 + p) for p in rng.integers(0, 3000, 400)) for _ in range(40)]
    encode = Encoder(32, 1, 3)
    whole = encode(texts)
    monkeypatch.setattr("proofmill.llm.language_id.BLOCK", 64)
    monkeypatch.setattr("proofmill.llm.language_id.CELLS", 40 * 256)
    monkeypatch.setattr("proofmill.llm.language_id.LETTERS", 100)
    assert (Encoder(32, 1, 3)(texts) == whole).all()
    assert (whole[7] == slow_bundle(texts[7], encode)).all()
