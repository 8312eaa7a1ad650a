"""SentencePiece encoding and decoding of BPE models with a prefix table.

BPE gives every prefix of a text one encoding, so one last token. The table stores it for each prefix: among
the pieces that end there (matches of an automaton over all pieces) it is the one that is compatible with the
last token of the prefix before it, where two tokens are compatible if BPE leaves their joined text as these
two. Ids are recovered backwards from the table's end. A sequence whose neighbours are all compatible is the
encoding: a merge across a border would have happened between these two neighbours alone.

A text is led by the word mark and its spaces become marks, as the library does. It is cut where no piece
holds the two characters side by side, since no merge crosses there. Distinct cuts of a batch are encoded
once, in sorted order, so that the table of a shared beginning is kept; results stay at hand for later batches, in
a bounded number. Characters without a piece fall back to their UTF-8 bytes.

Null and empty texts have the end id alone. Decoding gives the text back, but the word mark itself comes back as a space, and
bytes that are no UTF-8 as U+FFFD; null ids decode to null. Very long texts need memory in proportion to their
length, also where nothing cuts them. Repeated rows are encoded alike. Other columns are not touched.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.llm.common import steps

MARK = "▁"
#: Encoded cuts and tested pairs that a task keeps; more begin anew. Longer cuts are not kept.
KEPT, TESTED, LONG = 600_000, 1_000_000, 64


class Model:
    """Pieces of a model file's bytes, and what encoding needs of them."""

    def __init__(self, serialized: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_proto=serialized)
        size = file.get_piece_size()
        self.end = file.eos_id()
        self.byte = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {k for k in range(size) if file.is_control(k) or file.is_unknown(k)}
        self.id = {file.id_to_piece(k): k for k in range(size) if k not in special and not file.is_byte(k)}
        self.cost = {p: -file.get_score(k) for p, k in self.id.items()}
        self.bytes = [b"" if k in special else file.id_to_piece(k).replace(MARK, " ").encode() for k in range(size)]
        for b, k in enumerate(self.byte):
            self.bytes[k] = bytes([b])
        # characters of longer pieces, numbered from 1, and which of them stand side by side in a piece
        letters = sorted({c for p in self.id if len(p) > 1 for c in p})
        self.letter = {c: n for n, c in enumerate(letters, 1)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.side = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.id:
            for x, y in zip(p, p[1:]):
                self.side[self.letter[x], self.letter[y]] = True
        # tokens by number: pieces by id, then characters that are no piece but part of one; 0 is any other character
        self.token = {p: k for p, k in self.id.items() if self.merged(p) == [p]}
        for c in letters:
            self.token.setdefault(c, size + self.letter[c])
        self.text = {k: p for p, k in self.token.items()}
        self.steps = {k: self.merges(p)[1] for k, p in self.text.items()}
        self.matches = ahocorasick.Automaton()
        for p, k in self.token.items():
            self.matches.add_word(p, (len(p), k))
        self.matches.make_automaton()
        self.longest = max(map(len, self.token))
        self.pair: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text as it is defined: the best pair first, of equal ones the leftmost."""
        return self.merges(text)[0]

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The parts in the end; and for each merge its cost with the first and last part that it leaves."""
        parts, cost, steps = list(text), self.cost, [(-inf, text[0], text[-1])]
        while len(parts) > 1:
            best = min(((cost[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in cost), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            steps.append((best[0], parts[0], parts[-1]))
        return parts, steps

    def compatible(self, before: int, token: int) -> bool:
        """Whether BPE of both texts together never merges across their border.

        The merges of the two happen in order of cost, those of the left one first if equal; at each moment
        the parts at the border must not be the better pair.
        """
        key = before << 20 | token
        found = self.pair.get(key)
        if found is None:
            if len(self.pair) > TESTED:
                self.pair.clear()
            found, cost = True, self.cost
            left, right = self.steps[before], self.steps[token]
            i = j = 0
            while True:
                next_left = left[i + 1][0] if i + 1 < len(left) else inf
                next_right = right[j + 1][0] if j + 1 < len(right) else inf
                across = cost.get(left[i][2] + right[j][1], inf)
                if across < next_left and across <= next_right and across < inf:
                    found = False
                    break
                if next_left == next_right == inf:
                    break
                if next_left <= next_right:
                    i += 1
                else:
                    j += 1
            self.pair[key] = found
        return found

    def cut(self, text: str) -> list[str]:
        """The text between places that no merge crosses."""
        numbers = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = [0, *(np.flatnonzero(~self.side[numbers[:-1], numbers[1:]]) + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def encode(self, cuts: list[str]) -> Iterator[bytes]:
        """Ids of each cut as 32-bit numbers; cuts come sorted, and keep the table of what they share with the one before."""
        pair, compatible, iterate, longest = self.pair, self.compatible, self.matches.iter, self.longest
        before, last, size = "", [0], [0]  # last token, and its length, of each prefix
        for text in cuts:
            same = 0
            for x, y in zip(text, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], size[same + 1 :]
            done = same  # prefixes up to here have their last token
            for at, (length, token) in iterate(text, max(0, same - longest + 1)):  # longest first, of those that end alike
                if at < done:
                    continue
                while done < at:
                    last.append(0)
                    size.append(1)
                    done += 1
                previous = last[at + 1 - length]
                if previous:
                    fits = pair.get(previous << 20 | token)
                    if fits is None:
                        fits = compatible(previous, token)
                    if not fits:
                        continue
                last.append(token)
                size.append(length)
                done += 1
            last.extend([0] * (len(text) - done))
            size.extend([1] * (len(text) - done))
            ids, end = [], len(text)
            while end:
                token, begin = last[end], end - size[end]
                if 0 < token < len(self.bytes):
                    ids.append(token)
                else:
                    ids.extend(self.byte[b] for b in reversed(text[begin:end].encode("utf-8", "surrogatepass")))
                end = begin
            before = text
            ids.reverse()
            yield array("i", ids).tobytes()


@lru_cache(maxsize=2)
def model(serialized: bytes) -> Model:
    """The model of a file's bytes; a worker process makes it once for all its tasks."""
    return Model(serialized)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Ids of texts, with a bounded memory of cuts: those met since it was half full, and those met in the half before."""

    def __init__(self, of: Model):
        self.of, self.known, self.older = of, {}, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cuts = [self.of.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known, older = self.known, self.older
        met = set().union(*cuts) - known.keys()
        again = met & older.keys()
        known.update((text, older[text]) for text in again)
        new = sorted(met - again)
        known.update(zip(new, self.of.encode(new)))
        out = [b"".join(map(known.__getitem__, found)) for found in cuts]
        for text in new:
            if len(text) > LONG:
                del known[text]
        if len(known) > KEPT // 2:
            self.known, self.older = {}, known
        return out


@lru_cache(maxsize=2)
def encoder(serialized: bytes) -> Encoder:
    return Encoder(model(serialized))


def encode(text: Column, serialized: bytes, end: bool = True) -> Column:
    """Ids of each text as an array, with the end id after them."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder(serialized)
        tail = np.array([of.of.end] * end, np.int32).tobytes()
        for column in batches:
            found = [data + tail for _, run in steps(column.to_pylist()) for data in of(run)]
            ends = np.cumsum([0, *(len(data) // 4 for data in found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return ids.asNondeterministic()(text)


def decode(ids: Column, serialized: bytes) -> Column:
    """The text that ids stand for; control ids say nothing, and the mark that leads a text is dropped."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model(serialized).bytes
        for column in batches:
            ends, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
            whole = (b"".join(map(of.__getitem__, values[i:j].tolist())) for i, j in zip(ends, ends[1:]))
            said = (b.removeprefix(b" ").decode("utf-8", "replace") for b in whole)
            yield pa.array([t if there else None for t, there in zip(said, column.is_valid().to_pylist())], pa.string())

    return texts.asNondeterministic()(ids)
