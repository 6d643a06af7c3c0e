"""A vocabulary as sorted blocks, and encoding that asks each word of many lines once and each block once.

The words are range-partitioned, sorted and cut into blocks of at most BLOCK_WORDS words, a file each, front-coded: a word is
stored as the number of bytes it shares with the one before and the rest. A directory holds the first word of every block.

Lines are encoded in two passes over what is stored. The first gives the distinct words of a chunk of lines (up to CHUNK_WORDS words, however
many lines) places of their own and writes the lines as places, with the chunk's words behind them. These words, of all chunks, are
range-partitioned and sorted, so that a task meets the blocks one after another and fetches each once, and the numbers found are
written as a table for each chunk. The second pass reads a chunk's numbers and puts them in the place of the places.
No token is shuffled: a frequent word is asked once for each chunk, and so is a frequent word that the vocabulary does not have.
Work grows with the lines and the words; memory is bounded by a block, KNOWN words, the directory, a chunk's words and the lines at hand.
"""

from __future__ import annotations

import bisect
import itertools
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

BLOCK_WORDS = 16_384
BLOCK_BYTES = 4 << 20
#: Words a task remembers, and lines it works on at once.
KNOWN = 200_000
KNOWN_BYTES = 64 << 20
LINES = 2_000
#: Distinct words, and bytes of them, behind which a chunk of lines ends.
CHUNK_WORDS = 400_000
CHUNK_BYTES = 64 << 20
BLOCKS = "block bigint, first binary, shared binary, lengths binary, rest binary, numbers binary"


# ---------------------------------------------------------------- blocks

def front_coded(words: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared and further lengths (uint32) of sorted words, and their further bytes."""
    shared = [0] + [len(os.path.commonprefix((a, b))) for a, b in itertools.pairwise(words)]
    rest = [w[n:] for w, n in zip(words, shared)]
    return np.array(shared, np.uint32).tobytes(), np.array([len(r) for r in rest], np.uint32).tobytes(), b"".join(rest)


def decoded(shared: bytes, lengths: bytes, rest: bytes) -> list[bytes]:
    out, word, at = [], b"", 0
    for n, more in zip(np.frombuffer(shared, np.uint32).tolist(), np.frombuffer(lengths, np.uint32).tolist()):
        word = word[:n] + rest[at:at + more]
        at += more
        out.append(word)
    return out


def write_dictionary(words: DataFrame, path: str, block_words: int = BLOCK_WORDS) -> str:
    """Writes ``words(word, idx)`` below the new folder ``path``; null words are left out, of equal ones the smallest index counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, numbers, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal made
            made += 1
            parts = [[made - 1], [held[0]], *([x] for x in front_coded(held)), [np.array(numbers, np.int64).tobytes()]]
            kinds = [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds)], names=["block", "first", "shared", "lengths", "rest", "numbers"])

        for batch in batches:
            for word, idx in zip(batch.column("word").cast(pa.binary()).to_pylist(), batch.column("idx").to_pylist()):
                if held and (len(held) >= block_words or size >= BLOCK_BYTES):
                    yield block()
                    held, numbers, size = [], [], 0
                held.append(word)
                numbers.append(idx)
                size += len(word)
        if held:
            yield block()

    spark = words.sparkSession
    one = words.filter("word IS NOT NULL").groupBy("word").agg(F.min("idx").cast("bigint").alias("idx"))
    one.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(cut, BLOCKS).write.partitionBy("block").parquet(f"{path}/blocks")
    spark.read.schema("first binary, block bigint").parquet(f"{path}/blocks").select("first", "block").write.parquet(f"{path}/directory")
    return path


def _tables(system: pyarrow.fs.FileSystem, folder: str) -> Iterator[pa.Table]:
    found = system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    for file in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with system.open_input_file(file) as source:
            yield pq.ParquetFile(source).read()


class Dictionary:
    """Numbers of words, read from blocks as they are asked for. The last block is kept, for words that come sorted."""

    def __init__(self, path: str):
        self.system, self.base = pyarrow.fs.FileSystem.from_uri(path)
        rows = sorted((first, block) for t in _tables(self.system, f"{self.base}/directory") for first, block in zip(t.column("first").to_pylist(), t.column("block").to_pylist()))
        self.firsts, self.blocks = [r[0] for r in rows], [r[1] for r in rows]
        self.known: dict[bytes, int | None] = {}
        self.size = 0
        self.fetched = 0
        self.last: tuple[int, dict[bytes, int]] = (-1, {})

    def _block(self, number: int) -> dict[bytes, int]:
        if self.last[0] != number:
            self.fetched += 1
            out = {}
            for table in _tables(self.system, f"{self.base}/blocks/block={self.blocks[number]}"):
                for row in table.to_pylist():
                    out.update(zip(decoded(row["shared"], row["lengths"], row["rest"]), np.frombuffer(row["numbers"], np.int64).tolist()))
            self.last = number, out
        return self.last[1]

    def numbers(self, words: list[bytes], unknown: int) -> list[int]:
        """The number of every word, ``unknown`` for a word that is not there."""
        if len(self.known) > KNOWN or self.size > KNOWN_BYTES:  # forgets all, so memory stays bounded
            self.known, self.size = {}, 0
        new = sorted(w for w in set(words) if w not in self.known)
        for place, group in itertools.groupby(new, lambda w: bisect.bisect_right(self.firsts, w) - 1):
            block = self._block(place) if place >= 0 else {}
            for word in group:
                self.known[word] = block.get(word)
                self.size += len(word)
        return [unknown if (n := self.known[w]) is None else n for w in words]


# ---------------------------------------------------------------- encoding

def encode(lines: DataFrame, path: str, column: str, unknown: int) -> DataFrame:
    """The lines with ``ids, length`` in place of ``column``, an array of words. The lines are written once, as places of words."""
    kept = [f for f in lines.schema.fields if f.name != column]
    names = [f.name for f in kept]
    stored = _with_places(lines, path, column, kept)
    _answer(stored, path, unknown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(path)
        held, numbers = None, np.zeros(0, np.int64)
        for whole in batches:
            chunks = whole.column("_chunk").to_numpy()
            cuts = sorted({*range(0, whole.num_rows, LINES), *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), whole.num_rows})
            for at, end in itertools.pairwise(cuts):
                if chunks[at] != held:
                    held, numbers = chunks[at], _numbers(system, f"{base}/numbers/chunk={chunks[at]}")
                batch = whole.slice(at, end - at)
                edges, places = _unpacked(batch.column("_places"))
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(numbers[places]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, pa.array(np.diff(edges))], names=[*names, "ids", "length"])

    schema = StructType([*kept, StructField("ids", ArrayType(LongType())), StructField("length", IntegerType())])
    return stored.filter("_places IS NOT NULL").select(*names, "_chunk", "_places").mapInArrow(run, schema)


def _with_places(lines: DataFrame, path: str, column: str, kept: list[StructField]) -> DataFrame:
    """Two kinds of rows, written: lines with ``_chunk`` and ``_places`` (int32 as bytes), and ``_chunk, _place, _word``, the words of the chunks."""
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, places, size, kinds = TaskContext.get().partitionId() << 32, {}, 0, []

        def rows(of_lines: list, n: int, packed: pa.Array, numbers: pa.Array, words: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*of_lines, pa.array(np.full(n, chunk, np.int64)), packed, numbers, words], names=[*names, "_chunk", "_places", "_place", "_word"])

        def asked() -> Iterator[pa.RecordBatch]:
            words, first = iter(places), 0
            while some := list(itertools.islice(words, BLOCK_WORDS)):
                n = len(some)
                yield rows([pa.nulls(n, k) for k in kinds], n, pa.nulls(n, pa.binary()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(some, pa.binary()))
                first += n

        for whole in batches:
            kinds = [whole.column(n).type for n in names]
            for at in range(0, whole.num_rows, LINES):
                batch = whole.slice(at, LINES)
                lists = batch.column(column)
                coded = pc.list_flatten(lists).dictionary_encode()
                before, words = len(places), coded.dictionary.cast(pa.binary())
                own = np.array([places.setdefault(w, len(places)) for w in words.to_pylist()], np.int32)
                size += int(pc.binary_length(words).to_numpy(zero_copy_only=False)[own >= before].sum())
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                n = batch.num_rows
                yield rows([batch.column(x) for x in names], n, _packed(lengths, own[coded.indices.to_numpy(zero_copy_only=False)]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
                if len(places) >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    yield from asked()
                    chunk, places, size = chunk + 1, {}, 0
        yield from asked()

    more = [StructField("_chunk", LongType()), StructField("_places", BinaryType()), StructField("_place", IntegerType()), StructField("_word", BinaryType())]
    schema = StructType([*(StructField(f.name, f.dataType, True, f.metadata) for f in kept), *more])
    lines.select(*names, column).mapInArrow(run, schema).write.parquet(f"{path}/lines")
    return lines.sparkSession.read.schema(schema).parquet(f"{path}/lines")


def _answer(stored: DataFrame, path: str, unknown: int) -> None:
    """Writes ``chunk, place, number``, a folder for each chunk. Words come to the blocks sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or Dictionary(path)
            numbers = words.numbers(batch.column("_word").to_pylist(), unknown)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("place"), pa.array(numbers, pa.int64())], names=["chunk", "place", "number"])

    asked = stored.filter("_word IS NOT NULL").selectExpr("_chunk AS chunk", "_place AS place", "_word")
    found = asked.repartitionByRange("_word").sortWithinPartitions("_word").mapInArrow(run, "chunk bigint, place int, number bigint")
    found.repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/numbers")


def _numbers(system: pyarrow.fs.FileSystem, folder: str) -> np.ndarray:
    """The numbers of a chunk's words by their places."""
    tables = list(_tables(system, folder))
    out = np.zeros(sum(t.num_rows for t in tables), np.int64)
    for t in tables:
        out[t.column("place").to_numpy()] = t.column("number").to_numpy()
    return out


def _packed(lengths: np.ndarray, places: np.ndarray) -> pa.Array:
    """Lists of int32 as bytes, a value for each list."""
    edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * places.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(places))]).cast(pa.binary())


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges (int32, from 0) and values of lists that ``_packed`` made."""
    packed = pa.concat_arrays([packed.cast(pa.binary())])
    _, offsets, values = packed.buffers()
    edges = np.frombuffer(offsets, np.int32)[packed.offset:packed.offset + len(packed) + 1]
    places = np.frombuffer(values or b"", np.uint8)[edges[0]:edges[-1]].view(np.int32)
    return (edges - edges[0]) // 4, places
