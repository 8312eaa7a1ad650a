"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each
rotated by its place (binding); a text is the sum of its n-grams' vectors (bundling); a language is the
sum of its texts' vectors at unit length. A text gets the language of the largest cosine.

n-grams are letters within a word, with one mark at either end. Texts that are null or without letters
get ``und`` and score 0. Ties go to the language first by code point. Repeated rows are worked out
alike. Rows without a language teach nothing; without any labelled row every text is ``und``. Rows of equal
id and text are in the sample together or not at all. Counts of n-grams are kept for a bounded number of cells, so
texts with many distinct letters need no more memory than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Folding, code_points, hash_share, small_batches, steps

UNKNOWN = "und"
#: n-gram vectors that are held at once.
BLOCK = 2048
#: Counts (texts by n-grams) that are held at once, and letters whose vectors are kept.
CELLS, LETTERS = 4_000_000, 20_000


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # language x dimension, of unit length
    seed: int
    order: int


def distinct(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each among them; ``most`` is above all of them."""
    if most > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(most, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[values]


class Encoder:
    """Bundles of texts; letter vectors are made from the seed and the code point when first met."""

    def __init__(self, dimension: int, seed: int, order: int):
        self.dimension, self.seed, self.order = dimension, seed, order
        self.fold, self.known = Folding(), {}

    def letter(self, point: int) -> np.ndarray:
        """The vector rotated for each place of an n-gram, the last place unrotated."""
        if point not in self.known:
            if len(self.known) >= LETTERS:
                self.known.clear()
            base = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimension, dtype=np.int8) * 2 - 1
            self.known[point] = np.stack([np.roll(base, self.order - 1 - k) for k in range(self.order)])
        return self.known[point]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """texts x dimension; a text without letters is all zero."""
        points, owner = code_points(texts)
        letters = self.fold(points)
        keep = letters != 0
        keep[1:] |= keep[:-1]  # one mark after each word
        keep[0] = True
        letters, owner = letters[keep], owner[keep]
        alphabet, place = distinct(letters, int(letters.max()) + 1)
        n, k = self.order, len(alphabet)
        if len(letters) < n or k < 2:
            return np.zeros((len(texts), self.dimension))
        codes = np.zeros(len(letters) - n + 1, np.int64)
        inner = np.ones(len(codes), bool)
        for j in range(n):
            part = letters[j : len(letters) - n + 1 + j]
            codes = codes * k + place[j : len(letters) - n + 1 + j]
            if 0 < j < n - 1:
                inner &= part != 0  # a mark stands at the ends alone
        codes, of = codes[inner], owner[1 : len(letters) - n + 2][inner]
        if not len(codes):
            return np.zeros((len(texts), self.dimension))
        grams, gram = distinct(codes, k**n)
        table = np.stack([self.letter(int(p)) for p in alphabet])
        out = np.zeros((len(texts), self.dimension))
        width = max(BLOCK, CELLS // len(texts) // BLOCK * BLOCK)
        if len(grams) > width:
            order = np.argsort(gram, kind="stable")
            of, gram = of[order], gram[order]
        for at in range(0, len(grams), BLOCK):
            if at % width == 0:
                here = slice(*np.searchsorted(gram, [at, at + width])) if len(grams) > width else slice(None)
                wide = min(width, len(grams) - at)
                counts = np.bincount(of[here] * np.int64(wide) + gram[here] - at, minlength=len(texts) * wide)
                counts = counts.reshape(len(texts), wide).astype(np.float32)
            rest, bound = grams[at : at + BLOCK], None
            for j in range(n - 1, -1, -1):
                rest, digit = np.divmod(rest, k)
                bound = table[digit, j] if bound is None else bound * table[digit, j]
            out += counts[:, at % width : at % width + BLOCK] @ bound.astype(np.float32)
        return out


def fit_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_language: int = 2000, dimension: int = 1024, order: int = 3, seed: int = 7, tasks: int = 8,
) -> Profiles:
    """Learn a profile for each language from a hash sample of about ``per_language`` texts of each.

    The bound holds per language whatever the size of the input: the rows of each language are counted
    first, and a row is in if the hash of its key and text is below that language's share.
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(10_001).collect()}
    if len(counts) > 10_000:
        raise ValueError("more than 10,000 languages: is this the language column?")
    if not counts:
        return Profiles([], np.zeros((0, dimension)), seed, order)
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, per_language / n))])
    sample = known.filter(hash_share(F.col("k"), F.col("t"), F.lit(seed)) < share[F.col("l")]).select("l", "t")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = Encoder(dimension, seed, order), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in steps(batch.column(1).to_pylist()):
                vectors = encode(texts)
                length = np.linalg.norm(vectors, axis=1)
                for k in np.flatnonzero(length):
                    sums[langs[first + k]] = sums.get(langs[first + k], 0) + vectors[k] / length[k]
        if sums:
            names = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[x].tolist() for x in names])], ["l", "v"])

    total: dict[str, np.ndarray] = {}
    for row in sample.repartition(tasks).mapInArrow(bundles, "l string, v array<double>").collect():
        total[row["l"]] = total.get(row["l"], 0) + np.array(row["v"])
    names = sorted(total)
    vectors = np.stack([total[x] / np.linalg.norm(total[x]) for x in names]) if names else np.zeros((0, dimension))
    return Profiles(names, vectors.astype(np.float32).astype(np.float64), seed, order)


def identify(text: Column, profiles: Profiles) -> Column:
    """Struct of ``lang``, ``score`` (cosine, 0 to 1) and ``margin`` (lead over the next language)."""
    names, vectors, seed, order = profiles.languages, profiles.vectors, profiles.seed, profiles.order

    @F.arrow_udf("lang string, score double, margin double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = Encoder(vectors.shape[1], seed, order)
        for column in batches:
            texts = column.to_pylist()
            langs, best, lead = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for first, run in steps(texts) if names else ():
                got = encode(run)
                length = np.linalg.norm(got, axis=1)
                cosine = (got @ vectors.T) / np.maximum(length, 1e-300)[:, None]
                order_ = np.argsort(-cosine, axis=1, kind="stable")
                for k in np.flatnonzero(length):
                    top = cosine[k, order_[k, 0]]
                    langs[first + k] = names[order_[k, 0]]
                    best[first + k] = min(1.0, max(0.0, top))
                    lead[first + k] = top - cosine[k, order_[k, 1]] if len(names) > 1 else top
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best), pa.array(lead)], ["lang", "score", "margin"])

    return scored.asNondeterministic()(text)  # so that the optimizer does not work it out twice
