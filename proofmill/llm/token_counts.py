"""Token counts of a unigram vocabulary by dynamic programming over a trie.

A text is cut into pre-tokens (runs without ASCII white space, each led by the word mark), and each
pre-token into the vocabulary's pieces so that their scores add up highest; ties take fewer pieces. A
character that is no piece falls back to its UTF-8 bytes, one token each, at ten below the lowest score.

The distinct pre-tokens of a batch go into a trie. The best score of a prefix depends on that prefix
alone, so it is worked out once, when its node is made, and every pre-token below shares it; the node
where a pre-token ends stores its count. The trie is kept from batch to batch and begun anew when it
has ``max_nodes`` nodes, which bounds memory and changes no count. A pre-token longer than
``LONG`` characters is worked out alike, but not kept.

Scores are logarithms of probabilities, so below 0. Null and empty texts have no tokens. Repeated rows are counted alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.llm.common import WORDS

MARK = "▁"
LONG = 64


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    longest: int
    unknown: float  # score of a character that is no piece


def read_vocabulary(path: str = "/opt/tokenizers/piece_bpe_32k.model") -> Vocabulary:
    """Pieces of a model file with log-probabilities by Zipf's law from their order, as the file has ranks only."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(k) for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    return vocabulary({p: -math.log(k + 2) for k, p in enumerate(pieces)})


def vocabulary(scores: dict[str, float]) -> Vocabulary:
    return Vocabulary(scores, max(map(len, scores), default=1), min(scores.values(), default=0.0) - 10)


class Trie:
    def __init__(self, words: Vocabulary, max_nodes: int):
        self.unknown, self.max_nodes = words.unknown, max_nodes
        # every ending of a piece, with a score if it is a piece: a longer one is looked for only below these
        self.endings: dict[str, float | None] = {p[k:]: None for p in words.scores for k in range(len(p))}
        self.endings.update(words.scores)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by 2^21 times the parent's number and the character's code point
        self.best, self.tokens = [0.0], [0]  # of the prefix that ends at each node
        self.count: dict[str, int] = {}  # of each pre-token, taken from its terminal node

    def extend(self, text: str, end: int, best: list[float], tokens: list[int]) -> None:
        """Append score and count of the prefix up to ``end`` to those of all shorter ones."""
        endings, begin = self.endings, end - 1
        score = endings.get(text[begin:end])
        if score is None:
            top = best[begin] + self.unknown
            fewest = tokens[begin] + len(text[begin:end].encode("utf-8", "surrogatepass"))
        else:
            top, fewest = best[begin] + score, tokens[begin] + 1
        while begin:
            begin -= 1
            score = endings.get(text[begin:end], 0)
            if score is None:
                continue
            if not score:  # no piece ends like this; logarithms of probabilities below 1 are never 0
                break
            total = best[begin] + score
            if total > top or total == top and tokens[begin] + 1 < fewest:
                top, fewest = total, tokens[begin] + 1
        best.append(top)
        tokens.append(fewest)

    def add(self, words: list[str]) -> None:
        """Insert words in order; what a word shares with the one before is already at hand."""
        child, before = self.child, ""
        path, best, tokens = [0], [0.0], [0]
        for word in words:
            text, keep = MARK + word, 0
            for x, y in zip(text, before):
                if x != y:
                    break
                keep += 1
            del path[keep + 1 :], best[keep + 1 :], tokens[keep + 1 :]
            for end in range(keep + 1, len(text) + 1):
                if end > LONG:  # worked out, but not kept
                    self.extend(text, end, best, tokens)
                    continue
                key = (path[-1] << 21) | ord(text[end - 1])
                node = child.get(key)
                if node is None:
                    node = child[key] = len(self.best)
                    self.extend(text, end, best, tokens)
                    self.best.append(best[-1])
                    self.tokens.append(tokens[-1])
                else:
                    best.append(self.best[node])
                    tokens.append(self.tokens[node])
                path.append(node)
            self.count[word] = tokens[-1]
            before = text[:LONG]

    def counts(self, texts: list[list[str]]) -> list[int]:
        if len(self.best) > self.max_nodes or len(self.count) > self.max_nodes:
            self.clear()
        words = sorted(set().union(*texts) - self.count.keys())
        self.add(words)
        of = self.count.__getitem__
        out = [sum(map(of, found)) for found in texts]
        for word in words:
            if len(word) >= LONG:
                del self.count[word]
        return out


def token_counts(text: Column, words: Vocabulary, max_nodes: int = 400_000) -> Column:
    """Struct of ``n_words`` and ``n_tokens``."""

    @F.arrow_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(words, max_nodes)
        for column in batches:
            n_words, n_tokens, held, size = [], [], [], 0
            for value in [*column.to_pylist(), None]:
                found = WORDS.findall(value or "")
                held.append(found)
                size += len(found)
                if size > 50_000:  # so that a batch of long texts does not hold all its words at once
                    n_words += map(len, held)
                    n_tokens += trie.counts(held)
                    held, size = [], 0
            n_words += map(len, held)
            n_tokens += trie.counts(held)
            yield pa.StructArray.from_arrays(
                [pa.array(n_words[: len(column)], pa.int64()), pa.array(n_tokens[: len(column)], pa.int64())],
                ["n_words", "n_tokens"],
            )

    return counted.asNondeterministic()(text)
