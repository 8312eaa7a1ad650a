import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from proofmill.llm import sentence_pieces as S
from proofmill.llm.queries import op13_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", " a", "a ", "\n", "a\n\nb", "▁", "a▁b", "<s>", "</s> <unk> <0x0A>", "日本語", "🎉 ok", "\x00a", "mmmm    mmmm",
    "a" * 999, "ab" * 40_000, "́́", "x　y", "1234567 89", "▁▁▁",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def odd_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    pieces = list(S.model(S.read_model(PATH)).id)
    mixed = ["".join(rng.choices("aeiounrst ▁\n,.é日0-_()<>'", k=rng.randint(1, 60))) for _ in range(1000)]
    glued = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(2000)]
    return ODD + mixed + glued


def test_ids_of_the_library(library):
    encoder = S.Encoder(S.Model(S.read_model(PATH)))
    texts = odd_texts(3)
    for k in range(0, len(texts), 500):
        run = texts[k : k + 500]
        assert [np.frombuffer(b, np.int32).tolist() for b in encoder(run)] == library.encode(run)


def test_small_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 50)
    monkeypatch.setattr(S, "TESTED", 20)
    encoder = S.Encoder(S.Model(S.read_model(PATH)))
    for text in odd_texts(4)[:400]:
        assert np.frombuffer(encoder([text])[0], np.int32).tolist() == library.encode(text)


def test_each_prefix_has_the_last_token_of_its_encoding():
    of = S.model(S.read_model(PATH))
    word = "▁internationalizations"
    for k in range(1, len(word) + 1):
        assert [of.text[t] for t in np.frombuffer(next(of.encode([word[:k]])), np.int32).tolist()] == of.merged(word[:k])


def test_compatible_pairs_are_those_that_merging_leaves():
    of, rng = S.model(S.read_model(PATH)), random.Random(6)
    tokens = [t for t, p in of.text.items() if len(p) < 5]
    for x, y in ((rng.choice(tokens), rng.choice(tokens)) for _ in range(20_000)):
        assert of.compatible(x, y) == (of.merged(of.text[x] + of.text[y]) == [of.text[x], of.text[y]])


def test_round_trip_and_edges(spark, library):
    model = S.read_model(PATH)
    rows = [(k, t) for k, t in enumerate([None, *ODD, "same", "same"])]
    frame = spark.createDataFrame(rows, "k int, text string").withColumn("ids", S.encode(F.col("text"), model))
    got = frame.withColumn("back", S.decode(F.col("ids"), model)).collect()
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") + [library.eos_id()]
        assert r["back"] == library.decode(r["ids"]) == (r["text"] or "").replace("▁", " ")
    bare = spark.createDataFrame([(None,), ([],), ([1, 2],), ([3 + 0xC3],)], "ids array<int>").select(S.decode(F.col("ids"), model).alias("t"))
    assert [r["t"] for r in bare.collect()] == [None, "", "", "�"]
    assert spark.createDataFrame([], "text string").select(S.encode(F.col("text"), model)).collect() == []


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "") + [library.eos_id()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
