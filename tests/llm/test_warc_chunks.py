import base64
import gzip
import hashlib
import io

import pytest

from vigilog.llm import warc_chunks as wc
from vigilog.llm.common import shared_path

SCHEMA = "page_id bigint, url string, html string, record_type int"


def expected(rows):
    groups = {}
    for page, _, html, _ in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        keeper = max(ids) if len(groups[html or ""]) > 1 and ids else page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if page == keeper else "revisit", None if page == keeper else keeper))
    return out


ROWS = [
    (1, "http://a/", "<p>é\r\n\r\nx</p>", 0), (2, None, "<p>é\r\n\r\nx</p>", 0), (3, "u\r\nX: y", "", 0), (4, "u", None, 0), (5, "u", "z" * 3_000_000, 0),
    (6, "u", "y" * 100, 0), (None, "u", "y" * 100, 0), (None, "u", "own", 0), (7, "u", "WARC/1.1\r\n\r\n", 0), (8, "u", "twice", 0), (8, "u", "twice", 0),
]


def test_report(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = [tuple(r) for r in wc.archive_report(spark, frame).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=order) == sorted(expected(ROWS), key=order)


def test_empty_table(spark):
    assert wc.archive_report(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("chunk, rotate", [(1, 1), (7, 300), (1 << 20, 1 << 30)])
def test_round_trip_of_bytes(spark, chunk, rotate):
    rows = [(i, f"u{i}", "é" * i + "\r\n" * (i % 3)) for i in range(40)]
    frame = spark.createDataFrame(rows, "record_id bigint, target string, payload string").repartition(3)
    folder = shared_path(spark, "warc")
    manifest = wc.write_archives(frame, folder, chunk, rotate)
    assert manifest.agg({"records": "sum"}).first()[0] == 40
    chunks = wc.read_archives(manifest, folder, chunk).orderBy("record_id", "chunk_no").collect()
    for i, url, text in rows:
        own = [c for c in chunks if c["record_id"] == i]
        payload = text.encode()
        assert b"".join(c["data"] for c in own) == payload
        assert all(len(c["data"]) <= chunk for c in own)
        upto = 0
        for c in own:  # every row carries the digest so far
            upto += len(c["data"])
            assert c["upto"] == upto
            assert c["digest"] == wc.base32(hashlib.sha1(payload[:upto]).digest())
        assert [c["last"] for c in own] == [False] * (len(own) - 1) + [True]
        assert own[-1]["digest"] == own[-1]["stated_digest"]
        assert own[0]["target"] == url


def test_a_record_is_a_gzip_member():
    packed = b""
    for i, payload in enumerate((b"one", b"", b"three" * 50_000)):
        head, length = wc.header(i, "u", "response", None, "D", len(payload))
        assert int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]) == length
        packed += gzip.compress(head + payload + b"\r\n\r\n")
    found = list(wc.parsed(io.BytesIO(packed), 1000, True))
    assert b"".join(r[5] for r in found if r[0] == 2) == b"three" * 50_000
    assert [r[0] for r in found if r[8]] == [0, 1, 2]
    with pytest.raises(EOFError):
        list(wc.parsed(io.BytesIO(packed[:-20]), 1000, True))


def test_a_large_payload_is_held_by_the_chunk(spark):
    """Digests over 60 MB in chunks of 1 MB take a few chunks of memory."""
    import tracemalloc

    import pyarrow as pa

    def stream():
        data = bytes(1 << 20)
        for k in range(60):
            yield pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array(["u"]), pa.array([k], pa.int32()), pa.array([data], pa.binary()), pa.array([k == 59])],
                                             names=["key", "record_id", "target", "chunk_no", "data", "last"])

    tracemalloc.start()
    rows = 0
    for _ in wc.digested(stream()):
        rows += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60 and peak < 8 << 20


def test_no_payload_is_shuffled(spark):
    frame = spark.createDataFrame([(i, "u", "same" if i % 2 else str(i)) for i in range(50)], "record_id bigint, target string, payload string").repartition(3)
    path, table = wc.chunk_table(frame, 3)
    decided = shared_path(spark, "decided")
    wc.decisions(table, decided)
    found = spark.read.parquet(decided)
    assert found.count() == 50 and found.filter("refers_to = 49").count() == 24
    assert table.filter("last").count() == 50 and table.count() > 50
