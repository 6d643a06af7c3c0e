"""WARC archives by way of a table of chunks.

Spark cuts every payload into rows of record key and chunk number, each with at most ``CHUNK`` bytes. A
pass over these rows adds the bytes so far and the SHA-1 of the payload up to there, so that the last chunk carries
the digest of the whole, and they are stored: the chunk table. Writers stream it into gzipped WARC/1.1 files (a member for
each record), readers stream the files back into such rows. Python holds a few chunks at a time, never a payload.

Equal payloads are stored once: the record with the largest id is the response, the
others are revisits that name it. That is decided on digests and ids alone; no payload is shuffled.

Files are written through ``pyarrow.fs`` to the shared folder, under names of their own
for every attempt of a task; a stored manifest lists only those of attempts that
Spark counted, so lost executors and repeated tasks leave no wrong records.

Defined cases: a null payload is an empty one; a null id never wins against a number,
and is its own response where no row of the group has an id; repeated rows of the
winning id are all responses; other columns are not read; no rows make no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.common import shared_path, stored

CHUNK = 1 << 20
ROTATE = 64 << 20
BATCH_BYTES = 8 << 20
LEVEL = 2
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Chunk rows that a writer reads at once.
READ_AT_ONCE = 32
CHUNK_ROWS = "key bigint, record_id bigint, target string, chunk_no int, data binary, upto bigint, digest string, last boolean"
MANIFEST = "file string, records bigint, bytes bigint"
READ_ROWS = "record_id bigint, target string, record_type string, refers_to bigint, chunk_no int, data binary, upto bigint, digest string, last boolean, stated_digest string, stated_bytes bigint"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of at most about BATCH_BYTES, measured by ``size(row)``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 100
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``key, record_id, target, chunk_no, data, last``: payloads cut by Spark, chunk after chunk; ``key`` tells the input's rows apart."""
    payload = F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary")
    plain = records.select(
        F.monotonically_increasing_id().alias("key"), F.col("record_id").cast("bigint").alias("record_id"), F.col("target").cast("string").alias("target"), payload.alias("payload"))
    count = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk)))
    cut = plain.select("key", "record_id", "target", count.alias("count"), F.posexplode(parts).alias("chunk_no", "data"))
    return cut.select("key", "record_id", "target", "chunk_no", "data", (F.col("chunk_no") == F.col("count") - 1).alias("last"))


def digested(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """CHUNK_ROWS of chunk rows in order: the bytes and the digest so far, one chunk at a time."""
    sha, upto = hashlib.sha1(), 0
    for batch in parts:
        columns = [batch.column(c) for c in ("key", "record_id", "target", "chunk_no", "data", "last")]
        for i in range(batch.num_rows):
            key, record_id, target, number, data, last = (c[i].as_py() for c in columns)
            if number == 0:
                sha, upto = hashlib.sha1(), 0
            sha.update(data)
            upto += len(data)
            yield key, record_id, target, number, data, upto, base32(sha.digest()), last


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> tuple[str, DataFrame]:
    """The stored chunk rows of ``records(record_id, target, payload)`` with running digests: their folder, and the table."""
    schema = arrow_schema(CHUNK_ROWS)
    path = shared_path(records.sparkSession, "chunks")
    rows = chunk_rows(records, chunk).mapInArrow(lambda parts: batches(digested(parts), schema, lambda r: len(r[4])), CHUNK_ROWS)
    return path, stored(rows, "chunks", path)


def decisions(chunks: DataFrame, path: str, least: int = 0) -> None:
    """Writes ``key, digest, bytes, refers_to`` of every record below ``path``, a folder for each task that cut the records.

    Of payloads that several rows have, all but that of the largest id are revisits of it. Only digests and ids are shuffled.
    """
    whole = chunks.filter("last").select("key", "record_id", "digest", F.col("upto").alias("bytes"))
    groups = whole.groupBy("digest", "bytes").agg(F.max("record_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("keeper").isNotNull() & (F.col("bytes") >= least)).drop("n")
    other = F.col("keeper").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("keeper"))
    found = whole.join(groups, ["digest", "bytes"], "left").select("key", "digest", "bytes", F.when(other, F.col("keeper")).alias("refers_to"), F.shiftright("key", 33).alias("part"))
    found.repartition("part").write.partitionBy("part").parquet(path, compression="zstd")


def header(record_id, target, kind, refers_to, digest: str, size: int) -> tuple[bytes, int]:
    """A record's header, and the length of its block."""
    http = HTTP.format(size)
    length = len(http.encode()) + (size if kind == "response" else 0)
    clean = "".join(c for c in (target or "") if c > " ")  # no line break may enter a header
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>",
        "WARC-Date: 2025-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    if kind == "revisit":
        lines[-2:-2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode(), length


def _tables(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    system, base = pyarrow.fs.FileSystem.from_uri(path)
    for name in names:
        yield from pq.ParquetFile(system.open_input_file(f"{base}/{name}")).iter_batches(READ_AT_ONCE)


def _file_names(path: str) -> list[str]:
    system, base = pyarrow.fs.FileSystem.from_uri(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".parquet"))


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK, rotate: int = ROTATE, least: int = 0) -> DataFrame:
    """Writes ``records(record_id, target, payload)`` below ``folder``; the stored manifest of the files.

    Payloads under ``least`` bytes are never revisits. A task writes the records of one or more chunk files, which it reads chunk by chunk.
    """
    spark = records.sparkSession
    chunks, table = chunk_table(records, chunk)
    decided = shared_path(spark, "decisions")
    decisions(table, decided, least)

    def run(parts):
        out = path = None
        records_in = size = 0
        made = []
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        packer, known, part = None, {}, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append((path, records_in, size))
                out = None

        for batch in parts:
            for names in batch.column("files").to_pylist():
                for rows in _tables(chunks, names):
                    columns = [rows.column(c) for c in ("key", "record_id", "target", "chunk_no", "data", "last")]
                    for i in range(rows.num_rows):
                        key, number = columns[0][i].as_py(), columns[3][i].as_py()
                        if number == 0:
                            if key >> 33 != part:
                                part = key >> 33
                                own = f"{decided}/part={part}"
                                known = {k: v for t in _tables(own, _file_names(own)) for k, *v in zip(*(t.column(c).to_pylist() for c in ("key", "digest", "bytes", "refers_to")))}
                            if out is None or size >= rotate:
                                close()
                                path, records_in, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                                out = system.open_output_stream(f"{base}/{path}", compression=None)
                            digest, total, refers_to = known[key]
                            kind = "response" if refers_to is None else "revisit"
                            head, _ = header(columns[1][i].as_py(), columns[2][i].as_py(), kind, refers_to, digest, total)
                            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            size += out.write(packer.compress(head))
                            records_in += 1
                        if refers_to is None:
                            size += out.write(packer.compress(columns[4][i].as_buffer()))
                        if columns[5][i].as_py():
                            size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["file", "records", "bytes"])

    system, base = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    by_task: dict[str, list[str]] = {}
    for name in _file_names(chunks):  # files of one task belong together, in order
        by_task.setdefault("-".join(name.split("-")[:2]), []).append(name)
    units = spark.createDataFrame([(names,) for names in by_task.values()], "files array<string>")
    return stored(units.repartition(max(1, len(by_task))).mapInArrow(run, MANIFEST), "manifest")


class Inflated:
    """The bytes behind the gzip members of a stream, with a buffer of a few times 64 KiB."""

    def __init__(self, raw):
        self.raw, self.box, self.rest, self.held = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.box.eof:
                self.rest, self.box = self.box.unused_data, zlib.decompressobj(31)
            data = self.box.unconsumed_tail or self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return False
            got = self.box.decompress(data, 1 << 18)
            if got:
                self.held += got
                return True

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self.more():
                raise EOFError("a record breaks off in its header")
        line, self.held = self.held[:at], self.held[at + 2:]
        return line

    def lines(self) -> list[str]:
        found = []
        while line := self.line():
            found.append(line.decode())
        return found

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one."""
        if not self.held and not self.more():
            raise EOFError("a record breaks off in its block")
        part, self.held = self.held[:n], self.held[n:]
        return part

    def ended(self) -> bool:
        return not self.held and not self.more()


def parsed(raw, chunk: int, data: bool) -> Iterator[tuple]:
    """The chunk rows of an archive, READ_ROWS; without ``data`` only each record's last."""
    source = Inflated(raw)
    while not source.ended():
        first, *fields = source.lines()
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in fields)
        number = lambda name: int(x) if (x := head.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
        left = int(head["Content-Length"])
        http = source.lines()
        left -= sum(len(x.encode()) + 2 for x in http) + 2
        fixed = (number("WARC-Record-ID"), head["WARC-Target-URI"], head["WARC-Type"], number("WARC-Refers-To"))
        stated = (head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]))
        sha, upto, count = hashlib.sha1(), 0, 0
        while True:
            got, need = [], min(chunk, left)
            while need:
                part = source.take(need)
                sha.update(part)
                need -= len(part)
                left -= len(part)
                upto += len(part)
                if data:
                    got.append(part)
            if data or not left:
                yield *fixed, count, b"".join(got) if data else None, upto, base32(sha.digest()), not left, *stated
            count += 1
            if not left:
                break
        if source.lines() or source.line():
            raise ValueError("a record has no proper end")


def read_archives(manifest: DataFrame, folder: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk rows of the files that the manifest lists, READ_ROWS."""
    schema = arrow_schema(READ_ROWS)

    def run(parts):
        system, base = pyarrow.fs.FileSystem.from_uri(folder)

        def rows():
            for batch in parts:
                for name in batch.column("file").to_pylist():
                    with system.open_input_stream(f"{base}/{name}", compression=None) as raw:
                        yield from parsed(raw, chunk, data)

        yield from batches(rows(), schema, lambda r: len(r[5] or b""))

    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    files = manifest.select("file")
    return files.repartition(max(tasks, files.rdd.getNumPartitions()), "file").mapInArrow(run, READ_ROWS)


def archive_report(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as WARC files, reads them back and describes each record.

    A revisit's length and digest are those its header states.
    """
    folder = folder or shared_path(spark, "warc")
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target"), F.col("html").alias("payload"))
    back = read_archives(write_archives(records, folder), folder, data=False).filter("last")
    response = F.col("record_type") == "response"
    return back.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.col("upto")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
