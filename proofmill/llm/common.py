"""Helpers that several operators share: tables, batches of text, letters, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of other characters than ASCII white space; the same in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

#: Characters that one numpy step works on, and texts in it at most; a longer text is a step of its own.
STEP_CHARS, STEP_TEXTS = 400_000, 256
#: Rows of an Arrow batch. Texts are long, and a batch of Spark's usual 10,000 could hold a gigabyte.
BATCH_ROWS = 256
#: Bits of a filter of ids, as a power of two, at most: 32 MB.
FILTER_BITS = 28


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; tasks that hand texts to Python get them in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hash_share(*keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every id of the one-column frame and for few others, false for null.

    It is a bitmap of checksums, of at most 2^FILTER_BITS bits: with more ids than that it holds it lets
    more others pass, so whoever uses it makes it exact by a join. It lets a scan keep texts out of a shuffle.
    """
    name = ids.columns[0]
    bits = min(FILTER_BITS, max(15, int(16 * ids.count()).bit_length()))
    mask = (1 << bits) - 1
    at = F.crc32(F.col(name).cast("string").cast("binary")).bitwiseAND(mask) + 1  # positions count from 1
    rows = (
        ids.filter(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    )
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        begin = (r["bucket"] - 1) * 4096
        bitmap[begin : begin + 4096] = np.frombuffer(r["bits"], np.uint8)

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        from zlib import crc32

        at = np.fromiter((-1 if i is None else crc32(str(i).encode()) & mask for i in column.to_pylist()), np.int64, len(column))
        there = bitmap[np.maximum(at, 0) >> 3] >> (np.maximum(at, 0) & 7).astype(np.uint8) & 1
        return pa.array((there == 1) & (at >= 0))

    return maybe


def steps(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch into runs of texts of bounded size: position of the first, and the texts (null as empty)."""
    first, run, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text or ""
        if run and (size + len(text) > STEP_CHARS or len(run) == STEP_TEXTS):
            yield first, run
            first, run, size = k, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts joined by line ends, with one before and one after; the text of each (the end belongs to its text)."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    lengths[0] += 1
    return points, np.repeat(np.arange(len(texts), dtype=np.int32), lengths)


class Folding:
    """Code point to lower-case letter (or digit, if asked), 0 for all else; filled in as code points turn up."""

    def __init__(self, digits: bool = False):
        self.digits, self.map = digits, np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.map[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                low = c.lower()
                self.map[p] = (ord(low) if len(low) == 1 else p) if c.isalpha() or self.digits and c.isdigit() else 0
            out = self.map[points]
        return out


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
