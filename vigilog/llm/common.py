"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word; ``bytes.split()`` splits at just these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="vigilog-llm-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session (a test) gets a folder of its own; any
    other master is refused, as its executors could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _test_folder()
    return f"{root.rstrip('/')}/vigilog-{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage and survives lost executors.

    Its shuffle files go with the write, as nothing reads them again; the session's setting is put back.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more from the shared folder."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows with texts that a Python pass takes at once; texts can be long, so far fewer than Spark's own 10,000.
BATCH_ROWS = 500


def small(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches cut to BATCH_ROWS rows.

    Spark bounds a batch by its bytes (``arrow.maxBytesPerBatch``); the cut bounds what becomes Python objects at once. No setting is changed.
    """
    return lambda batches: run(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks put behind it until ``df`` has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of every text; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class WordHash(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:  # forgets all, so memory stays bounded
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes64(words: list[bytes], cache: WordHash, size: int) -> np.ndarray:
    """64-bit hashes of every run of ``size`` words, in order; fewer words are one shingle, none are none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + one[i:n - width + 1 + i]
    return mixed(total)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int) -> Column:
    """Whether a row is kept out of training; a row without id always is."""
    return F.coalesce(fold(doc_id, parts) == 0, F.lit(True))
