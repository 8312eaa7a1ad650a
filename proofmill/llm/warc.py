"""WARC archives: written with segmentation, read back by reassembly.

Writing: each page becomes an HTTP response with chunked transfer framing in a WARC/1.1 record. A block
above ``segment`` characters is cut: the first part is the response record, the others are continuation
records with the identifier of the origin, a segment number and, on the last, the total length. Of pages
with equal payloads of ``revisit_from`` bytes or more, the one with the smallest id is a response and the
others are revisit records that refer to it. Spark's text writer joins records by the two line ends that close
each of them, so files are plain WARC, gzipped as a whole, with at most ``per_file`` records.

Reading: a file is read record by record at the stated lengths. A record without segments is decoded on
the spot; continuation records are grouped by their origin, ordered by segment number and checked against the
total length, and only these are shuffled. Chunked framing is taken off last.

A null payload is the empty one. A null id is written and read as null, and comes after all others when
the smallest is sought. Repeated rows are records of their own; of equal ids the first row read is the
response. An origin with a missing segment or a wrong length gives a row with ``complete`` false and no payload.

Broken archives stop nothing. A record without a type, identifier or right length, with a wrong chunk length, or in a
file that is cut short or damaged gives a row with ``complete`` false, no payload, and as much of its header as
was read (all null, if none); reading goes on at the next line that begins a record. Bytes between records that belong
to none give one such row for each run of them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT, CHUNK, PER_FILE, REVISIT_FROM = 16_384, 4096, 4000, 100
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
RECORD = "record_id string, record_type string, refers_to string, origin_id string, segment int, total long, digest string, block binary, payload binary, payload_bytes long"
BEGINS = re.compile(rb"WARC/\d\.\d\s*$")
DAMAGE = (EOFError, OSError, zlib.error)


def lines(*fields: Column | str) -> Column:
    return F.concat_ws(END, *[F.lit(f) if isinstance(f, str) else f for f in fields])


def field(name: str, value: Column | str) -> Column:
    """A header line, or null without a value; ``concat_ws`` leaves nulls out."""
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"))


def cut(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunked(payload: Column, size: int) -> Column:
    framed = F.transform(cut(payload, size), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(END), c, F.lit(END)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + END + END))


def salted(left: DataFrame, right: DataFrame, key: str, by: Column, salts: int = 16) -> DataFrame:
    """Left join to unique keys, the rows of a frequent key spread over ``salts`` tasks."""
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(many, [key, "_salt"], "left").drop("_salt")


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE, revisit_from: int = REVISIT_FROM,
) -> None:
    """Write every page as a record of a WARC archive below ``path``."""
    base = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    name = F.concat(F.lit(URN), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("row").cast("string"))
    base = base.withColumn("name", name)
    first = (
        base.filter(F.octet_length("payload") >= revisit_from).groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "name")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", F.col("first.name").alias("response"))
    )
    rows = salted(base, first, "digest", F.col("row"))
    again = F.col("response").isNotNull() & (F.col("response") != F.col("name"))
    http = lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "Transfer-Encoding: chunked", "", "")
    block = F.when(again, http).otherwise(F.concat(http, chunked(F.col("payload"), chunk)))
    parts = rows.withColumn("again", again).withColumn("block", block).withColumn("length", F.octet_length("block")).select(
        "name", "url", "digest", "response", "again", "length", F.size(cut(F.col("block"), segment)).alias("parts"),
        F.posexplode(cut(F.col("block"), segment)).alias("no", "part"),
    )
    own, cutup, follows, last = F.col("no") == 0, F.col("parts") > 1, F.col("no") > 0, F.col("no") == F.col("parts") - 1
    brackets = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    record = lines(
        "WARC/1.1",
        field("WARC-Type", F.when(follows, "continuation").when(F.col("again"), "revisit").otherwise("response")),
        field("WARC-Record-ID", brackets(F.when(own, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.col("no"))))),
        field("WARC-Date", DATE),
        F.when(own, field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))),
        F.when(own, field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        F.when(own & F.col("again"), field("WARC-Refers-To", brackets(F.col("response")))),
        F.when(own & F.col("again"), field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(cutup, field("WARC-Segment-Number", F.col("no") + 1)),
        F.when(follows, field("WARC-Segment-Origin-ID", brackets(F.col("name")))),
        F.when(cutup & last, field("WARC-Segment-Total-Length", F.col("length"))),
        F.when(own, field("Content-Type", "application/http; msgtype=response")),
        field("Content-Length", F.octet_length("part")),
        F.lit(""), F.col("part"),
    )
    parts.select(record.alias("value")).write.options(
        lineSep=END + END, compression="gzip", maxRecordsPerFile=str(per_file)
    ).text(path)


class Returning:
    """A stream to which bytes that were read can be given back."""

    def __init__(self, stream: io.BufferedIOBase):
        self.stream, self.back = stream, io.BytesIO()

    def give_back(self, data: bytes) -> None:
        self.back = io.BytesIO(data + self.back.read())

    def readline(self) -> bytes:
        line = self.back.readline()
        return line if line.endswith(b"\n") else line + self.stream.readline()

    def read(self, size: int) -> bytes:
        """At most ``size`` bytes, a megabyte at a time: a stated length is no reason to ask for the memory."""
        parts = [self.back.read(size)]
        size -= len(parts[0])
        while size and (part := self.stream.read(min(size, 1 << 20))):
            parts.append(part)
            size -= len(part)
        return b"".join(parts)


def whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields, in lower case, and block of each record of a gzipped file; the block of a broken one is None."""
    fields: dict[str, str] = {}
    lost = False  # whether what is read belongs to a broken record that has its row
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        file = Returning(stream)
        try:
            while line := file.readline():
                if line.strip() == b"":
                    continue
                fields = {}
                if not BEGINS.match(line):
                    if not lost:
                        yield {}, None
                    lost = True
                    continue
                while line := file.readline():
                    if BEGINS.match(line):  # a header that breaks off
                        file.give_back(line)
                    if BEGINS.match(line) or not line.strip():
                        break
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    fields[name.strip().lower()] = value.strip()
                size, block, end = whole_number(fields.get("content-length")), b"", b""
                if size is not None and not BEGINS.match(line):
                    block, end = file.read(size), file.read(4)
                if size is not None and len(block) == size and end == b"\r\n\r\n" and {"warc-type", "warc-record-id"} <= fields.keys():
                    yield fields, block
                    lost = False
                else:
                    file.give_back(block + end)
                    if "warc-record-id" in fields or not lost:
                        yield fields, None
                    lost = True
        except DAMAGE:
            if "warc-record-id" in fields or not lost:
                yield fields, None


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP message, without chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload_of(block: bytes | None) -> bytes | None:
    """As :func:`decoded`, None for broken framing."""
    try:
        return None if block is None else decoded(block)
    except ValueError:
        return None


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record; ``payload`` (left out if not asked for) and its length and digest where no segment is missing."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("origin_id", pa.string()),
            ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records_of(content.as_py()):
                    number, kind = whole_number(fields.get("warc-segment-number")), fields.get("warc-type")
                    record = bare(fields.get("warc-record-id"))
                    whole = payload_of(block) if number is None and kind == "response" else None
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    if whole is not None:
                        digest = hashlib.sha256(whole).hexdigest()
                    elif block is None or number is None and kind == "response":
                        digest = None
                    rows.append((
                        record, kind, bare(fields.get("warc-refers-to")), bare(fields.get("warc-segment-origin-id")) or record,
                        number, whole_number(fields.get("warc-segment-total-length")),
                        digest, block if number else None, whole if payloads else None, None if whole is None else len(whole),
                    ))
                    size += len(block or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of origins cut into segments, put together: as ``read_records``, with ``complete``."""
    parts = records.filter(F.col("segment").isNotNull())
    grouped = parts.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
    )

    @F.arrow_udf("digest string, payload binary, payload_bytes long")
    def joined(parts: pa.Array, totals: pa.Array) -> pa.Array:
        out = []
        for row, total in zip(parts, totals.to_pylist()):
            row = row.as_py()
            block = b"".join(p["block"] or b"" for p in row)
            payload = None
            if [p["segment"] for p in row] == list(range(1, len(row) + 1)) and len(block) == total:
                payload = payload_of(block)
            out.append({} if payload is None else {"digest": hashlib.sha256(payload).hexdigest(), "payload": payload if payloads else None, "payload_bytes": len(payload)})
        return pa.array(out, pa.struct([("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())]))

    whole = grouped.withColumn("p", joined("parts", "total")).select(
        F.col("origin_id").alias("record_id"), "record_type", F.lit(None).cast("string").alias("refers_to"), "p.*"
    )
    single = records.filter(F.col("segment").isNull()).select("record_id", "record_type", "refers_to", "digest", "payload", "payload_bytes")
    both = single.unionByName(whole)
    revisit = F.col("record_type").eqNullSafe("revisit") & F.col("digest").isNotNull()
    return both.withColumn("complete", revisit | F.col("payload_bytes").isNotNull())


def resolved(rows: DataFrame) -> DataFrame:
    """Give revisits the length of what they refer to."""
    again = F.col("record_type").eqNullSafe("revisit")
    revisits, others = rows.filter(again).drop("payload_bytes"), rows.filter(~again)
    asked = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    lengths = others.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("refers_to"), "payload_bytes")
    return others.unionByName(salted(revisits, lengths, "refers_to", F.col("record_id")))


def page_of(record: Column) -> Column:
    """The page id in one of our record identifiers."""
    return F.split_part(F.substring(record, len(URN) + 1, 64), F.lit(":"), F.lit(1)).try_cast("long")
