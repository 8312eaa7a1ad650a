import math
import random

from pyspark.sql import functions as F

from proofmill.llm.common import WORDS
from proofmill.llm.token_counts import LONG, MARK, Trie, Vocabulary, read_vocabulary, token_counts, vocabulary

SF = "/root/testdata/sf0.001"


def slow_count(word: str, words: Vocabulary) -> int:
    """Best sum of scores over all ways to cut the word, then fewest tokens."""
    text = MARK + word
    best = [(0.0, 0)] + [(math.inf, 0)] * len(text)  # negated scores
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(end):
            piece = text[begin:end]
            if piece in words.scores:
                options.append((best[begin][0] - words.scores[piece], best[begin][1] + 1))
            elif len(piece) == 1:
                options.append((best[begin][0] - words.unknown, best[begin][1] + len(piece.encode("utf-8", "surrogatepass"))))
        best[end] = min(options)
    return best[-1][1]


def test_small_vocabulary_with_ties():
    words = vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, MARK: -1.0, MARK + "a": -2.0, "bb": -1.5})
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcü", k=rng.randint(1, 9))) for _ in range(300)] + ["ab" * LONG, "c" * 500, "b" * (LONG - 1), "b" * LONG]
    for nodes in (5, 10_000):
        trie = Trie(words, nodes)
        assert trie.counts([[t] for t in texts]) == [slow_count(t, words) for t in texts]
        assert trie.counts([texts]) == [sum(slow_count(t, words) for t in texts)]


def test_documents(spark):
    words = read_vocabulary()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    known: dict[str, int] = {}
    for r in docs.select("text", token_counts(F.col("text"), words, max_nodes=3000).alias("o")).collect():
        found = WORDS.findall(r["text"])
        for w in set(found) - known.keys():
            known[w] = slow_count(w, words)
        assert (r["o"]["n_words"], r["o"]["n_tokens"]) == (len(found), sum(map(known.get, found)))


def test_same_as_a_unigram_model():
    from tokenizers import Tokenizer, models

    words = read_vocabulary()
    model = models.Unigram([("<unk>", -100.0), *words.scores.items()], 0, False)
    plain = Tokenizer(model)
    texts = ["the", "tokenization", "Überraschung", "internationalization", "x1y2", "qqqzzz"]
    trie = Trie(words, 1000)
    assert [len(plain.encode(MARK + t).ids) for t in texts] == trie.counts([[t] for t in texts])


def test_edges(spark):
    rows = [(None,), ("",), (" \t\r\n",), ("the",), ("the",), ("x" * 300_000,)]
    got = [tuple(r["o"]) for r in spark.createDataFrame(rows, "text string").select(token_counts(F.col("text"), read_vocabulary()).alias("o")).collect()]
    assert got[:3] == [(0, 0)] * 3 and got[3] == got[4] == (1, 1) and got[5][0] == 1 and got[5][1] > 1000
