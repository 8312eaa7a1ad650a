"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both tokenizers cut the same bytes, a space and the text. Byte offsets where both end a token cut the
tokens into groups, and within a group every token of one is linked with every token of the other.

A fragment holds the tokens of a byte range: those up to the first common end (its open prefix, all of them
where there is none), closed groups, and those after the last common end (its open suffix). Two neighbours are
composed by aligning the suffix of the first with the prefix of the second; this is associative, as the
result depends on the joined tokens alone. The smallest fragment is that of a unit, a run of text between single spaces
inside words, before which both tokenizers always cut; a task keeps the fragments of the units it has met, and
a document is the composition of its units'. A document of more than ``LONG`` characters is cut into chunks that begin
where either tokenizer alone cuts, so at two places; chunks are dealt over the tasks, and their
fragments composed eight at a time in rounds of a tree.

In how many documents a pair of ids is linked is counted by blocks, since most pairs come in most of them: a
task's documents, up to bounds on units and their occurrences, are a block, which lists each of its pairs once. Pairs
are added up over blocks and come back to the block, where its documents are scored.

Links of a group are counted by pairs of distinct ids, so a long group without a common end does no harm. Texts that are null or
empty, or that either tokenizer changes (as one with the word mark itself), have no tokens. A document's text and
groups must fit a task. Rows that share an id are documents of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import small_batches, steps
from proofmill.session import written_once

MARK = "▁"
#: Documents of more characters go on in chunks of this size; fragments composed at once in the tree.
LONG, CHUNK, AT_ONCE = 65_536, 32_768, 8
#: Units of a block, and their occurrences in its documents.
UNITS, OCCURRENCES = 120_000, 800_000
#: Places where both tokenizers cut, and where the second does.
BOTH_CUT, SECOND_CUT = re.compile(r"(?<=\S) (?=\S)"), re.compile(rf"(?<=[^ {MARK}]) (?=.)", re.DOTALL)

#: Bytes that byte-level vocabularies write as themselves; the others follow from U+0100, in order.
AS_THEMSELVES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Tokens(NamedTuple):
    """Ids and end offsets of the first tokenizer's tokens, then the second's."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def between(self, low: int, high: int) -> Tokens:
        """Tokens that end after low, and at high at most."""
        i, j = np.searchsorted(self.a_ends, (low, high), "right")
        k, m = np.searchsorted(self.b_ends, (low, high), "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def joined(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(c) for c in zip(self, other)))


class Closed(NamedTuple):
    """Whole groups: their text, numbers of tokens of either kind, and linked pairs with how often they are linked."""

    texts: tuple[str, ...] = ()
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: np.ndarray = np.zeros(0, np.int64)
    times: np.ndarray = np.zeros(0, np.int64)

    def __add__(self, other: Closed) -> Closed:
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, other.times]), len(pairs)).astype(np.int64)
        return Closed(self.texts + other.texts, self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, pairs, times)


class Fragment(NamedTuple):
    """Without a cut, all tokens are the prefix."""

    prefix: Tokens
    cut: bool
    closed: Closed
    suffix: Tokens


NONE = Tokens(*(np.zeros(0, np.int64),) * 4)


class Aligner:
    """Two tokenizers and how many bytes each of their tokens has."""

    def __init__(self, byte_level: str, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(byte_level)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=pieces)
        others = [b for b in range(256) if b not in set(AS_THEMSELVES)]
        byte = {chr(b): b for b in AS_THEMSELVES} | {chr(0x100 + k): b for k, b in enumerate(others)}
        self.a_bytes = [b""] * self.first.get_vocab_size()
        for token, k in self.first.get_vocab(with_added_tokens=False).items():
            self.a_bytes[k] = bytes(byte[c] for c in token)
        self.size = self.second.get_piece_size()
        names = [self.second.id_to_piece(k) for k in range(self.size)]
        if any(re.search(rf"[^{MARK}]{MARK}", p) for p in names):
            raise ValueError("a piece goes on over a space, so texts can't be cut before spaces")
        self.b_bytes = [
            b"" if self.second.is_control(k) or self.second.is_unknown(k)
            else bytes([int(p[1:-1], 16)]) if self.second.is_byte(k) else p.replace(MARK, " ").encode()
            for k, p in enumerate(names)
        ]
        self.a_length, self.b_length = (np.array([len(b) for b in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.names = max(len(self.a_bytes), self.size)
        self.spelled = [f"{k}{mark}" for mark in ",|;" for k in range(self.names)]

    def encode(self, a_texts: list[str], b_texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts as they are, and of texts to which the second tokenizer adds a space."""
        from os import environ

        environ["TOKENIZERS_PARALLELISM"] = "false"
        return [e.ids for e in self.first.encode_batch_fast(a_texts, add_special_tokens=False)], self.second.encode(b_texts, num_threads=1)

    def same(self, a: list[int], b: list[int], want_a: bytes, want_b: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == want_a and b"".join(map(self.b_bytes.__getitem__, b)) == want_b

    def tokens(self, a: list[int], b: list[int], a_begin: int = 0, b_begin: int = 0) -> Tokens:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Tokens(a, a_begin + np.cumsum(self.a_length[a]), b, b_begin + np.cumsum(self.b_length[b]))

    def groups(self, tokens: Tokens, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids as text, each with the mark after it, and where each group's begin (each ends at an offset, and the

        beginning after the last is their number); and for the linked pairs, their group, the pair as a number, how often.
        """
        of_a, of_b = np.searchsorted(ends, tokens.a_ends), np.searchsorted(ends, tokens.b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        a_at, b_at = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        marked = np.empty(len(tokens.a) + len(tokens.b), np.int64)
        marked[np.arange(len(of_a)) + b_at[of_a]] = tokens.a
        marked[np.arange(len(of_b)) + a_at[of_b + 1]] = tokens.b
        marked[a_at[1:] - 1 + b_at[:-1]] += self.names
        marked[a_at[1:] - 1 + b_at[1:]] += 2 * self.names
        texts = list(map(self.spelled.__getitem__, marked.tolist()))
        large = n_a * n_b > 4096
        fan = np.where(large, 0, n_b)[of_a]  # links of each token of the first kind, in groups that are not large
        group = np.repeat(of_a, fan)
        at = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(b_at[of_a], fan)
        found = [(group, np.repeat(tokens.a, fan) * self.size + tokens.b[at], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(large).tolist():
            x, n = np.unique(tokens.a[a_at[g] : a_at[g + 1]], return_counts=True)
            y, m = np.unique(tokens.b[b_at[g] : b_at[g + 1]], return_counts=True)
            found.append((np.full(len(x) * len(y), g), np.add.outer(x * self.size, y).ravel(), np.outer(n, m).ravel()))
        return texts, a_at + b_at, *(np.concatenate(c) for c in zip(*found))

    def closed(self, tokens: Tokens, ends: np.ndarray) -> Closed:
        """All groups that end at the offsets; the tokens end with the last of them."""
        if not len(ends):
            return Closed()
        texts, _, _, pairs, times = self.groups(tokens, ends)
        return Closed(("".join(texts)[:-1],), len(tokens.a), len(tokens.b), len(ends), pairs, times) + Closed()

    def fragment(self, tokens: Tokens) -> Fragment:
        ends = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
        if not len(ends):
            return Fragment(tokens, False, Closed(), NONE)
        first, last, past = int(ends[0]), int(ends[-1]), np.iinfo(np.int64).max
        return Fragment(tokens.between(-1, first), True, self.closed(tokens.between(first, last), ends[1:]), tokens.between(last, past))

    def group(self, tokens: Tokens) -> Closed:
        """A prefix that began with a group."""
        return self.closed(tokens, tokens.a_ends[-1:])

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        middle = self.fragment((x.suffix if x.cut else x.prefix).joined(y.prefix))
        if not x.cut and not y.cut:
            return middle
        if not x.cut:
            return Fragment(middle.prefix, True, middle.closed + y.closed, y.suffix)
        if not middle.cut:
            return x._replace(suffix=middle.prefix)
        closed = x.closed + self.group(middle.prefix) + middle.closed
        return Fragment(x.prefix, True, closed + y.closed, y.suffix) if y.cut else Fragment(x.prefix, True, closed, middle.suffix)

    def tree(self, fragments: list[Fragment]) -> Fragment:
        while len(fragments) > 1:
            fragments = [reduce(self.compose, fragments[k : k + 2]) for k in range(0, len(fragments), 2)]
        return fragments[0]


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: bytes) -> Aligner:
    """A worker process makes it once for all its tasks."""
    return Aligner(byte_level, pieces)


class Block:
    """Documents with the units that they hold."""

    def __init__(self, of: Aligner, texts: bool):
        self.of, self.texts = of, texts
        self.number: dict[str, int] = {}
        self.said: list[str | None] = []  # groups of each unit, None where a tokenizer changes it
        self.facts: list[np.ndarray] = []  # tokens of either kind, groups, links of each unit
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # pairs of each unit
        self.docs: list[tuple] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        self.occurrences = 0

    def full(self) -> bool:
        return len(self.said) > UNITS or self.occurrences > OCCURRENCES

    def learn(self, units: list[str]) -> None:
        """Take up units that are not known yet."""
        of = self.of
        # units without white space at their ends are read together, as both tokenizers cut before the space between them
        alone = [u for u in units if u.strip() != u]
        plain = sorted(set(units).difference(alone)) if alone else units
        runs = [plain[k : k + 2000] for k in range(0, len(plain), 2000)] + [[u] for u in alone]
        said = [" ".join(run) for run in runs]
        again = []
        for run, text, a, b in zip(runs, said, *of.encode([" " + t for t in said], said)):
            whole = (" " + text).encode()
            if of.same(a, b, whole, whole):
                self.take(run, of.tokens(a, b))
            else:
                again += run
        for unit in again:  # one of the run is changed
            (a,), (b,) = of.encode([" " + unit], [unit])
            whole = (" " + unit).encode()
            self.take([unit], of.tokens(a, b) if of.same(a, b, whole, whole) else None)

    def take(self, units: list[str], tokens: Tokens | None) -> None:
        """Units of a run of tokens; without tokens, a unit that a tokenizer changes."""
        begin, n = len(self.said), len(units)
        self.number.update(zip(units, range(begin, begin + n)))
        if tokens is None:
            self.said += [None] * n
            self.facts.append(np.zeros((n, 4), np.int64))
            self.sizes.append(np.zeros(n, np.int64))
            return
        of = self.of
        ends = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
        texts, at, group, pairs, times = of.groups(tokens, ends)
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        unit = np.searchsorted(unit_ends, ends)  # of each group
        n_groups = np.bincount(unit, minlength=n)
        first = at[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        self.said += ["".join(texts[i:j])[:-1] for i, j in pairwise(first)]
        space = len(of.a_bytes) * of.size
        keys, back = np.unique(unit[group] * space + pairs, return_inverse=True)
        self.times.append(np.bincount(back, times).astype(np.int32))
        self.pairs.append((keys % space).astype(np.int32 if space < 1 << 31 else np.int64))
        self.sizes.append(np.bincount(keys // space, minlength=n))
        n_a, n_b = (np.bincount(np.searchsorted(unit_ends, e), minlength=n) for e in (tokens.a_ends, tokens.b_ends))
        self.facts.append(np.stack([n_a, n_b, n_groups, np.bincount(unit[group], times, n).astype(np.int64)], 1))

    def add(self, ids: list, texts: list[str]) -> None:
        split = [BOTH_CUT.split(t) if t else [] for t in texts]
        new = sorted(set(chain.from_iterable(split)) - self.number.keys())
        if new:
            self.learn(new)
            self.facts = [np.concatenate(self.facts)]
        for doc, units in zip(ids, split):
            found = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
            said = [self.said[k] for k in found.tolist()]
            if not said or None in said:
                self.docs.append((doc, 0, 0, 0, 0, "", "" if self.texts else None))
                self.bags.append((found[:0], found[:0]))
                continue
            text = ";".join(said)
            sha = hashlib.sha256(text.encode()).hexdigest()
            self.docs.append((doc, *self.facts[0][found].sum(0).tolist(), sha, text if self.texts else None))
            self.bags.append(tuple(c.astype(np.int32) for c in np.unique(found, return_counts=True)))
            self.occurrences += len(self.bags[-1][0])

    def row(self) -> dict:
        pairs, at = np.unique(np.concatenate([*self.pairs, np.zeros(0, np.int32)]), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([*self.sizes, np.zeros(0, np.int64)]))])
        counts, place = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for units, _ in self.bags:
            size = ends[units + 1] - ends[units]
            held = at[np.repeat(ends[units] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            place[held] = np.arange(len(held))  # the last writer stands for its pair
            counts[held[place[held] == np.arange(len(held))]] += 1
        return {
            "block": uuid.uuid4().hex, "pairs": pairs.astype(np.int64), "counts": counts,
            "docs": packed((self.docs, self.bags)),
            "units": packed((ends, at.astype(np.int32), np.concatenate([*self.times, np.zeros(0, np.int32)]))),
        }


BLOCK = "block string, pairs array<long>, counts array<long>, docs binary, units binary"
FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"


def packed(value: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value))


def unpacked(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def block_batch(row: dict) -> pa.RecordBatch:
    long_list, types = pa.list_(pa.int64()), {"block": pa.string(), "docs": pa.binary(), "units": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, long_list)) for k, v in row.items()], list(row))


def blocks(docs: DataFrame, models: tuple[str, bytes], texts: bool) -> DataFrame:
    """Documents of ``id, text`` in blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(aligner(*models), texts)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, run in steps(batch.column(1).to_pylist()):
                block.add(ids[first : first + len(run)], run)
                if block.full():
                    yield block_batch(block.row())
                    block = Block(block.of, texts)
        if block.docs:
            yield block_batch(block.row())

    return docs.mapInArrow(scan, BLOCK)


def chunks(text: str, size: int) -> Iterator[tuple[str, str, int, int]]:
    """Text of each chunk for either tokenizer, without the space that the second adds, and byte offsets of both."""
    places = []
    for cut in (BOTH_CUT, SECOND_CUT):
        found = [0]
        while found[-1] < len(text):
            at = cut.search(text, max(len(found) * size, found[-1] + 1))
            found.append(at.start() if at else len(text))
        places.append(found)
    a, b = places
    for found in (a, b):
        found += [len(text)] * (max(len(a), len(b)) - len(found))
    a_begin = b_begin = 0
    for (i, j), (k, m) in zip(pairwise(a), pairwise(b)):
        a_text = text[i:j] if i else " " + text[:j]
        b_text = text[k:m] if k else " " + text[:m]
        yield a_text, b_text[1:], a_begin, b_begin
        a_begin += len(a_text.encode("utf-8", "surrogatepass"))
        b_begin += len(b_text.encode("utf-8", "surrogatepass"))


def long_blocks(docs: DataFrame, models: tuple[str, bytes], chunk: int, texts: bool) -> DataFrame | None:
    """Each long document as a block of its own; its chunks are read by as many tasks as there are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = uuid.uuid4().hex
                for k, (a_text, b_text, a_begin, b_begin) in enumerate(chunks(text, chunk)):
                    row = {"key": key, "id": doc, "k": k, "a_text": a_text, "b_text": b_text, "a_begin": a_begin, "b_begin": b_begin}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                        ("key", pa.string()), ("id", batch.schema.field(0).type), ("k", pa.int64()), ("a_text", pa.string()),
                        ("b_text", pa.string()), ("a_begin", pa.int64()), ("b_begin", pa.int64()),
                    ]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(*models)
        for batch in batches:
            found = []
            for a_text, b_text, a_begin, b_begin in zip(*(batch.column(n).to_pylist() for n in ("a_text", "b_text", "a_begin", "b_begin"))):
                # an empty range of the second tokenizer has no space either
                (a,), (b,) = of.encode([a_text], [b_text])
                want = (" " + b_text if b_text else "").encode("utf-8", "surrogatepass")
                kept = of.same(a, b, a_text.encode("utf-8", "surrogatepass"), want)
                found.append(packed(of.fragment(of.tokens(a, b, a_begin, b_begin)) if kept else None))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "id", "k")), pa.array(found, pa.binary())], ["key", "id", "k", "fragment"])

    def compose(table: pa.Table) -> pa.Table:
        of = aligner(*models)
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        parts = [unpacked(r["fragment"]) for r in rows]
        whole = None if any(p is None for p in parts) else of.tree(parts)
        out = rows[0] | {"k": rows[0]["k"] // AT_ONCE, "fragment": packed(whole)}
        return pa.Table.from_pylist([out], schema=table.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(*models)
        for batch in batches:
            for doc, data in zip(batch.column("id").to_pylist(), batch.column("fragment").to_pylist()):
                whole, block = unpacked(data), Block(of, texts)
                if whole is None:
                    block.add([doc], [""])
                else:
                    closed = of.group(whole.prefix) + whole.closed  # a text begins with a group and ends with one
                    text = ";".join(closed.texts)
                    facts = (closed.n_a, closed.n_b, closed.n_groups, int(closed.times.sum()))
                    block.docs.append((doc, *facts, hashlib.sha256(text.encode()).hexdigest(), text if texts else None))
                    block.bags.append((np.zeros(1, np.int64), np.ones(1, np.int64)))
                    block.pairs, block.times, block.sizes = [closed.pairs], [closed.times], [np.array([len(closed.pairs)])]
                yield block_batch(block.row())

    kind = docs.schema["id"].dataType.simpleString()
    cut_up = written_once(docs.mapInArrow(cut, f"key string, id {kind}, k long, a_text string, b_text string, a_begin long, b_begin long"), "chunks")
    most = cut_up.agg(F.max("k")).first()[0]
    if most is None:
        return None
    schema = f"key string, id {kind}, k long, fragment binary"
    parts = written_once(cut_up.repartition("key", "k").mapInArrow(read, schema), "fragments")
    while most:
        parts = written_once(parts.groupBy("key", F.floor(F.col("k") / AT_ONCE).alias("_")).applyInArrow(compose, schema), "fragments")
        most //= AT_ONCE
    return parts.mapInArrow(finish, BLOCK)


def align(docs: DataFrame, byte_level: str, pieces: bytes, key: str = "doc_id", text: str = "text",
          long: int = LONG, chunk: int = CHUNK, texts: bool = True) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the groups (``texts``) and their digest, and

    how common its links are: ``count_sum`` adds up, over links, the number of documents that hold the link's pair;
    ``n_best`` counts links whose pair is held by most documents among all pairs of its first id.
    """
    small_batches(docs.sparkSession)
    models = (byte_level, pieces)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    found = written_once(blocks(rows.filter(~is_long), models, texts), "blocks")
    others = long_blocks(rows.filter(is_long), models, chunk, texts)
    if others is not None:
        found = found.unionByName(written_once(others, "long-blocks"))

    # an id pair's documents; the best of a first id is one of at most as many rows as the vocabulary has
    size = aligner(*models).size
    listed = found.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "of"))
    listed = listed.select("block", "at", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("here"))
    counted = listed.withColumn("n", F.sum("here").over(Window.partitionBy("pair"))).drop("here")
    counted = written_once(counted.withColumn("a", F.floor(F.col("pair") / size)).drop("pair"), "counted")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))
    counted = counted.join(F.broadcast(best), "a").select("block", "at", "n", (F.col("n") == F.col("most")).alias("best"))

    kind = rows.schema["id"].dataType.simpleString()

    def score(block: pa.Table, pairs: pa.Table) -> pa.Table:
        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        types = [id_type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
        at = pairs.column("at").to_numpy()
        n, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], is_best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
        out = []
        for docs_, units in zip(block.column("docs").to_pylist(), block.column("units").to_pylist()):
            (ends, held, times), (facts, bags) = unpacked(units), unpacked(docs_)
            sums = [np.concatenate([[0], np.cumsum(times * of[held])]) for of in (is_best, n)]
            sums = [s[ends[1:]] - s[ends[:-1]] for s in sums]  # of each unit
            out += ((*f, *(int((s[u] * t).sum()) for s in sums)) for f, (u, t) in zip(facts, bags))
        names = [key, *(c.split()[0] for c in FACTS.split(", "))]
        columns = zip(*out) if out else [[]] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    scored = found.select("block", "docs", "units").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, f"{key} {kind}, {FACTS}")
    return scored if texts else scored.drop("groups")
