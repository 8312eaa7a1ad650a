"""Toxicity from subword bags: n-gram embeddings, averaged over a word, into a linear softmax.

A word is a run of letters and digits between two marks; its bag holds the n-grams of three to six
characters, marks included, and the word itself. Embeddings and softmax are trained together in numpy,
so a misspelling that nobody labelled still shares most of its n-grams with the word it stands for.

Labels belong to texts, so the softmax is trained twice over: first on words, each counted under the
labels of the texts that hold it, then on texts, each judged by its worst word. That worst word also
gives a text its score. Averaging over the whole text instead would hide one word among thousands.

At prediction the average and the softmax are both linear, so each n-gram carries one number, the
product of its embedding and the weights, and a text is scored in one pass over its characters.

Texts that are null or without any word get the score of an empty bag, the lowest of all. Rows with a
null label teach nothing, and of several labels of one row the largest counts. Of several texts of one id the one
with the least hash is learned from, and none above ``longest`` characters; all texts are scored, whole. Ids that
labels are joined by are whole numbers. Without labels of both kinds, or in an empty table, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Folding, code_points, hash_share, steps

SIZES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # of each bucket: embedding times softmax weights
    bias: float


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


class Bags:
    """n-grams of the words of texts: bucket, position and validity, n by n."""

    def __init__(self, bits: int):
        self.bits, self.fold = bits, Folding(digits=True)

    def read(self, texts: list[str]) -> None:
        points, owner = code_points(texts)
        chars = self.fold(points)
        keep = chars != 0
        keep[1:] |= keep[:-1]  # the mark after a word is also the one before the next
        keep[0] = True
        self.chars, owner = chars[keep], owner[keep]
        marks = np.flatnonzero(self.chars == 0)
        self.start, self.ends = marks[:-1], marks[1:]
        self.text = owner[self.start + 1] if len(self.start) else owner[:0]
        gaps = np.diff(marks)
        self.next = np.append(np.repeat(self.ends, gaps), marks[-1:]) if len(marks) else marks

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n: the position where an n-gram begins and its bucket; last, each whole word."""
        c = self.chars.astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, SIZES[-1] + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            if n in SIZES:
                at = np.flatnonzero(np.arange(n - 1, len(c)) <= self.next[: len(h)])
                yield at, mixed(h[at], self.bits)
        if len(self.start):
            place = np.arange(len(c)) - np.repeat(self.start, np.diff(np.append(self.start, len(c))))
            key = c * np.power(np.uint64(0x5851F42D4C957F2D), place.astype(np.uint64))
            yield self.start, mixed(np.add.reduceat(key, self.start) + np.uint64(97), self.bits)

    def words(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of each word's bag."""
        if not len(self.start):
            return np.zeros(0)
        total = np.zeros(len(self.chars), np.float32)
        for at, bucket in self.grams():
            total[at] += weights[bucket]
        length = self.ends - self.start + 1  # with both marks
        number = 1 + sum(np.maximum(length - n + 1, 0) for n in SIZES)
        return np.add.reduceat(total, self.start) / number


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
    per_label: int = 2500, longest: int = 1_000_000, bits: int = 19, dimension: int = 8, seed: int = 11,
    word_rounds: int = 6, text_rounds: int = 60,
) -> Model:
    """Train on a hash sample of about ``per_label`` texts of each label, of at most ``longest`` characters, whatever the size of the input."""
    given = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
        .join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    )
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, 0.0)
    share = F.when(F.col("y") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    chosen = given.filter(hash_share(F.col("k"), F.lit(seed)) < share)
    # about 2 * per_label keys whatever the input, so they go to the texts and not the texts to them
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = sample.filter(F.coalesce(F.length("t"), F.lit(0)) <= longest)
    sample = sample.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    return train(sample.select("k", "t", "y"), bits, dimension, seed, word_rounds, text_rounds)


def train(sample: DataFrame, bits: int, dimension: int, seed: int, word_rounds: int, text_rounds: int) -> Model:
    """Bring each sampled text's distinct words to one place and train there; the sample is bounded."""

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folding(digits=True)
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for _, run in steps(texts):
                for t in run:
                    chars = fold(code_points([t])[0])
                    spaced = np.where(chars == 0, 32, chars).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    out.append("\n".join(sorted(set(spaced.split()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], ["k", "y", "w"])

    rows = sample.mapInArrow(distinct_words, "k long, y int, w string").toArrow().sort_by([("k", "ascending"), ("w", "ascending")])
    y = rows.column("y").to_numpy().astype(np.float32)
    ids: dict[str, int] = {}
    lists = [np.fromiter((ids.setdefault(w, len(ids)) for w in (x.as_py() or "").split("\n") if w), np.int32) for x in rows.column("w")]
    if not ids:
        return Model(None, 0.0)
    texts = [k for k, x in enumerate(lists) if len(x)]
    y, lists = y[texts], [lists[k] for k in texts]
    flat, first = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    bags = Bags(bits)
    word, bucket, names = [], [], list(ids)
    for at in range(0, len(names), 50_000):
        bags.read([" ".join(names[at : at + 50_000])])
        begin = np.repeat(np.arange(len(bags.start)), np.diff(np.append(bags.start, len(bags.chars))))
        for place, b in bags.grams():
            word.append(begin[place].astype(np.int32) + at)
            bucket.append(b)
    word, bucket = np.concatenate(word), np.concatenate(bucket)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    size = np.bincount(word, minlength=len(names)).astype(np.float32)
    edge = np.concatenate([[0], np.cumsum(size.astype(np.int64))[:-1]])

    rng = np.random.default_rng(seed)
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    embed = rng.normal(0, 0.1, (len(used), dimension)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, dimension).astype(np.float32), 0.0  # difference of the two classes' weights
    step_e, step_w, step_b = np.full(embed.shape, 1e-6, np.float32), np.full(dimension, 1e-6), 1e-6

    def logits(which: np.ndarray | None = None) -> np.ndarray:
        if which is None:
            return np.add.reduceat((embed @ soft)[bucket], edge) / size + bias
        part, owner = picked(which)
        return np.bincount(owner, (embed @ soft)[bucket[part]], len(which)) / size[which] + bias

    def picked(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[which].astype(np.int64)
        owner = np.repeat(np.arange(len(which)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + edge[which][owner], owner

    def learn(which: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """One AdaGrad step for the loss whose derivative by the logit of word ``which`` is ``slope``."""
        nonlocal soft, bias, step_b
        part, owner = picked(which)
        weight = (slope / size[which])[owner].astype(np.float32)
        rows_, local = np.unique(bucket[part], return_inverse=True)
        total = np.bincount(local, weight, len(rows_)).astype(np.float32)  # the same for every dimension, up to soft
        grad_w, grad_e, grad_b = total @ embed[rows_], total[:, None] * soft, float(slope.sum())
        step_e[rows_] += grad_e**2
        step_w[:] += grad_w**2
        step_b += grad_b**2
        embed[rows_] -= rate * grad_e / np.sqrt(step_e[rows_])
        soft = (soft - rate * grad_w / np.sqrt(step_w)).astype(np.float32)
        bias -= rate * grad_b / np.sqrt(step_b)

    def chance(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both labels weigh alike
    good = np.bincount(flat, share[of] * (y[of] == 0), len(names))
    bad = np.bincount(flat, share[of] * (y[of] == 1), len(names))
    for _ in range(word_rounds):
        for block in np.array_split(rng.permutation(len(names)), max(1, len(names) // 20_000)):
            p = chance(logits(block))
            learn(block, (good[block] + bad[block]) * p - bad[block], 0.1)
    step_e[:], step_w[:], step_b = 1e-6, 1e-6, 1e-6
    for _ in range(text_rounds):
        z = logits()
        top = np.maximum.reduceat(z[flat], first)
        hit = z[flat] == top[of]
        worst = np.zeros(len(lists), np.int64)
        worst[of[hit][::-1]] = flat[hit][::-1]  # the first of the worst
        learn(worst, (chance(top) - y) * share, 0.1)
    top = np.maximum.reduceat(logits()[flat], first)
    scale, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps for the softmax's scale and bias over whole texts
        p = chance(scale * top + shift)
        slope, curve = p - y, p * (1 - p) + 1e-6
        grad = np.array([slope @ top + 1e-2 * (scale - 1), slope.sum()])
        hess = np.array([[curve @ top**2 + 1e-2, curve @ top], [curve @ top, curve.sum()]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        scale, shift = scale - move[0], shift - move[1]
    soft, bias = soft * np.float32(scale), scale * bias + shift
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = embed @ soft
    return Model(weights, float(bias))


def score(text: Column, model: Model) -> Column:
    """Probability, 0 to 1, that the text's worst word makes it toxic; 0 for a text without words."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bags = None if weights is None else Bags(int(len(weights)).bit_length() - 1)
        for column in batches:
            texts = column.to_pylist()
            out = np.zeros(len(texts))
            for first, run in steps(texts) if bags else ():
                bags.read(run)
                top = np.full(len(run), -np.inf)
                np.maximum.at(top, bags.text, bags.words(weights) + bias)
                out[first : first + len(run)] = np.where(np.isneginf(top), 0, 1 / (1 + np.exp(-np.clip(top, -700, 700))))
            yield pa.array(out)

    return scored.asNondeterministic()(text)
