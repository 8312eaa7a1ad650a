import gzip
import hashlib
import os

from proofmill.llm import warc

LONG = "ä\r\n\r\nWARC/1.1\r\n" * 700


def pages():
    return [
        (1, "http://a/\r\nx", "<p>short</p>"), (2, None, None), (3, "u", ""), (4, "u", "z" * 100), (9, "u", "z" * 100), (5, "u", LONG),
        (7, "u", LONG), (8, "u", "y" * 99), (6, "u", "y" * 99), (None, "u", "z" * 100), (12, "u", "q" * 150), (12, "u", "q" * 150), (20, "u", "𝒳" * 9000),
    ]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "warc")
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, path, segment=1000, chunk=64, per_file=4)
    records = warc.read_records(spark, path)
    assert records.filter("record_type = 'continuation'").count() > 10
    rows = warc.resolved(warc.reassemble(records)).withColumn("page_id", warc.page_of(warc.F.col("record_id"))).withColumn("of", warc.page_of(warc.F.col("refers_to"))).collect()
    assert all(r["complete"] for r in rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["of"]) for r in rows), key=str)
    want = []
    again = {9: 4, 7: 5, None: 4}
    twelve = 0
    for i, _, html in pages():
        body = (html or "").encode()
        first = again.get(i)
        if i == 12:
            first, twelve = (12 if twelve else None), twelve + 1
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=str)
    payload = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert payload[5] == LONG.encode() and payload[20] == ("𝒳" * 9000).encode() and payload[2] == b""


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string"), path)
    [name] = [n for n in os.listdir(path) if n.endswith(".gz")]
    raw = gzip.open(os.path.join(path, name)).read()
    head, body = raw.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a" in head
    assert body == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n\r\n\r\n"
    assert f"Content-Length: {len(body) - 4}".encode() in head


def test_missing_and_mixed_segments(spark):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
    cut = [http[:20], http[20:40], http[40:]]
    rows = [("o", 3, cut[2], len(http)), ("o", 1, cut[0], None), ("o", 2, cut[1], None), ("p", 1, cut[0], None), ("p", 3, cut[2], len(http)), ("q", 1, cut[0], None), ("q", 2, cut[1], len(http))]
    df = spark.createDataFrame(
        [(f"{o}{n}", "response" if n == 1 else "continuation", None, o, n, t, "", b, None, None) for o, n, b, t in rows], warc.RECORD
    )
    got = {r["record_id"]: (r["complete"], r["payload"]) for r in warc.reassemble(df).collect()}
    assert {k: (c, p and bytes(p)) for k, (c, p) in got.items()} == {"o": (True, b"ab"), "p": (False, None), "q": (False, None)}


def test_broken_records_stop_nothing(spark, tmp_path):
    def record(name, block, kind="response", size=None, more=b""):
        length = b"" if size == -1 else b"Content-Length: %d\r\n" % (len(block) if size is None else size)
        return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%s%s\r\n%s\r\n\r\n" % (kind.encode(), name.encode(), more, length, block)

    def http(body):
        return b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body

    good = http(b"2\r\nab\r\n0\r\n\r\n")
    half = [good[:20], good[20:]]
    number = b"WARC-Segment-Number: %d\r\n"
    total = b"WARC-Segment-Origin-ID: <s>\r\nWARC-Segment-Total-Length: %d\r\n" % len(good)
    files = {
        "a.gz": record("a1", good) + record("a2", http(b"zz\r\nab\r\n0\r\n\r\n")) + record("a3", http(b"9\r\nab\r\n0\r\n\r\n")) + record("a4", http(b"")) + record("a5", good),
        "b.gz": record("b1", good, size=-1) + record("b2", good, size=3) + record("b3", good, size=10**17) + record("b4", good),
        "c.gz": b"no record\r\nat all\r\n" + record("c1", good) + b"WARC/1.1\r\nWARC-Type: response\r\n" + record("c2", good),
        "e.gz": b"", "f.gz": record("s", half[0], more=number % 1) + record("s#1", half[1], "continuation", more=number % 2 + total),
        "g.gz": record("t", half[0], more=number % 1) + record("t#1", half[1], "continuation", size=2, more=number % 2 + total.replace(b"<s>", b"<t>")),
        "h.gz": record("h1", b"", "revisit", more=b"WARC-Payload-Digest: sha256:00\r\nWARC-Refers-To: <a1>\r\n") + record("h2", good),
    }
    path = tmp_path / "warc"
    path.mkdir()
    for name, raw in files.items():
        (path / name).write_bytes(gzip.compress(raw))
    many = gzip.compress(b"".join(record(f"d{k}", good + os.urandom(50)) for k in range(50)))
    (path / "d.gz").write_bytes(many[: len(many) // 2])
    (path / "i.gz").write_bytes(b"not gzipped")
    rows = warc.resolved(warc.reassemble(warc.read_records(spark, str(path)))).collect()
    known = {r["record_id"]: (r["complete"], r["payload"] and bytes(r["payload"])) for r in rows if r["record_id"] and not r["record_id"].startswith("d")}
    right, broken = (True, b"ab"), (False, None)
    assert known == {
        "a1": right, "a2": broken, "a3": broken, "a4": broken, "a5": right, "b1": broken, "b2": broken, "b3": broken, "b4": right,
        "c1": right, "c2": right, "s": right, "t": broken, "h1": (True, None), "h2": right,
    }
    assert sum(r["record_id"] is None for r in rows) == 3  # two in c.gz, the file that is none
    cut = [r for r in rows if (r["record_id"] or "").startswith("d")]
    assert 5 < len(cut) < 50 and sum(not r["complete"] for r in cut) <= 1
    assert next(r["payload_bytes"] for r in rows if r["record_id"] == "h1") == 2


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.reassemble(warc.read_records(spark, path))).collect() == []
