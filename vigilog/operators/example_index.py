"""The nearest known example through a stored cell index: exact, without reading the whole bank in any task.

Build. Equal unit vectors count once, with their lowest index. Pivots (at most MOST_CELLS of them, picked by hash) cut the
bank into cells, a vector belonging to its nearest pivot. Spark deals the vectors out by cell and by
distance from the pivot, splits what is too much for a task, and writes blocks of at most BLOCK_ROWS vectors, a file each.
A directory holds, for every block, the least and the greatest distance from its own and from REFERENCES other pivots.

Search. By the triangle inequality an example in a block is at least max(d - greatest, least - d) away from a target at
distance d from a pivot, which bounds the cosine. Distinct targets first go to the block that promises most; the best
cosine found there rules out all blocks whose bound is below it. The target then goes once to each group of GROUP
blocks of which some are left, with the marks of these, so vectors that no bound rules out are not sent once for every block. A task
reads the blocks of its targets only, one at a time, and Spark splits the targets of a hot block or group. The best by (cosine, lowest index) is merged per target and joined back.

Rows equal those of ``scoring.nearest_example``, which reads all examples in one narrow pass. ``nearest`` takes that
one for banks of up to SCAN_ROWS examples, where a shuffle would cost more than it saves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.scoring import DECIMALS, LAST, Encoder, _distinct_rows, _unit_rows, _vector_rows, nearest_example

SCAN_ROWS = 4096
CELL_ROWS = 64
MOST_CELLS = 1024
BLOCK_ROWS = 8192
REFERENCES = 16
#: Blocks that a target is sent to at once.
GROUP = 16
#: Bounds are kept this much too wide, for rounding: those of cosines, and those of distances, whose square is what is exact.
MARGIN = 1e-9
SLACK = 2e-6
#: Bounds worked out at once.
BOUNDS = 1 << 22

VECTORS = "idx bigint, vector binary"
PLACED = "idx bigint, vector binary, cell int, distance double"
BLOCKS = "block bigint, cell int, ids array<bigint>, vectors binary, least array<double>, greatest array<double>"
FOUND = "vector binary, block bigint, which bigint, score double, idx bigint"


@dataclass(frozen=True)
class ExampleIndex:
    """A stored index: its folder, its pivots, and what needs no search."""

    path: str
    dim: int
    pivots: np.ndarray
    lowest: int  # index of the first example
    blank: int  # index of the first example without any direction

    @property
    def empty(self) -> bool:
        return self.dim == 0 and self.blank == LAST


# ---------------------------------------------------------------- numpy helpers used inside tasks

def _units(values: pa.Array, encoder: Encoder | None, what: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Unit vectors of a column and, where texts were encoded once each, the row's place among them."""
    if encoder is not None:
        vectors, rows = _distinct_rows(values, encoder, encoder(["x"]).shape[1])
        return _unit_rows(vectors), rows
    sizes = pc.unique(pc.list_value_length(values).drop_null()).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"{what}vectors of different sizes: {sizes}")
    return _unit_rows(_vector_rows(values, sizes[0] if sizes else 0)), None


def _binary(units: np.ndarray) -> pa.Array:
    """Vectors as bytes; one without direction as none. Adding 0.0 makes minus zeros plain zeros."""
    return pa.array([(row + 0.0).tobytes() if row.any() else b"" for row in units], pa.binary())


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _distances(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ others.T), 0.0))


def _read(path: str) -> Iterator[pa.Table]:
    system, base = pyarrow.fs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")):
        yield pq.ParquetFile(system.open_input_file(file)).read()


class Directory:
    """Bounds of all blocks: a row for every BLOCK_ROWS examples."""

    def __init__(self, index: ExampleIndex):
        table = pa.concat_tables(_read(f"{index.path}/directory"))
        self.pivots = index.pivots
        self.block, self.cell = (table.column(n).to_numpy() for n in ("block", "cell"))
        width = min(REFERENCES, len(index.pivots)) + 1
        self.least, self.greatest = (
            table.column(n).combine_chunks().flatten().to_numpy().reshape(-1, width) for n in ("least", "greatest"))

    def parts(self, n: int) -> Iterator[slice]:
        step = max(BOUNDS // max(len(self.block), 1), 1)
        return (slice(at, min(at + step, n)) for at in range(0, n, step))

    def gaps(self, distances: np.ndarray) -> np.ndarray:
        """The least possible distance of every target (its distances from the pivots) from every block."""
        out = np.zeros((len(distances), len(self.block)))
        for k in range(self.least.shape[1]):
            d = distances[:, self.cell] if k == self.least.shape[1] - 1 else distances[:, k:k + 1]
            np.maximum(out, d - self.greatest[:, k], out=out)
            np.maximum(out, self.least[:, k] - d, out=out)
        return np.maximum(out - SLACK, 0.0)

    def homes(self, units: np.ndarray) -> np.ndarray:
        """The block that promises most: the nearest one of the nearest pivot's cell."""
        out = np.empty(len(units), np.int64)
        for part in self.parts(len(units)):
            d = _distances(units[part], self.pivots)
            filled = np.unique(self.cell)
            nearest = filled[d[:, filled].argmin(axis=1)]
            gaps = np.where(self.cell == nearest[:, None], self.gaps(d), np.inf)
            out[part] = self.block[gaps.argmin(axis=1)]
        return out

    def left(self, units: np.ndarray, homes: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks but the home that may hold something as good as the best."""
        rows, blocks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in self.parts(len(units)):
            gaps = self.gaps(_distances(units[part], self.pivots))
            may = (1.0 - gaps * gaps / 2.0 + MARGIN >= best[part][:, None]) & (self.block != homes[part][:, None])
            r, b = np.nonzero(may)
            rows.append(r + part.start)
            blocks.append(self.block[b])
        return np.concatenate(rows), np.concatenate(blocks)

    def grouped(self, rows: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, marks of its blocks) of (row, block)."""
        order = np.argsort(self.block)
        group, bit = np.divmod(order[np.searchsorted(self.block, blocks, sorter=order)], GROUP)
        groups = -(-len(self.block) // GROUP)
        keys, of = np.unique(rows * groups + group, return_inverse=True)
        which = np.bincount(of, np.left_shift(1, bit), minlength=len(keys)).astype(np.int64)
        return keys // groups, keys % groups, which

    def marked(self, group: int, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each block of a group and the places of ``which`` that have its mark."""
        for bit, block in enumerate(self.block[group * GROUP:(group + 1) * GROUP].tolist()):
            places = np.flatnonzero(which >> bit & 1)
            if len(places):
                yield block, places


class Blocks:
    """Reads blocks by number and keeps the last one."""

    def __init__(self, index: ExampleIndex):
        self.index, self.number, self.ids, self.matrix = index, None, None, None

    def best(self, number: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest cosine with an example of the block, and the lowest index that has it."""
        if number != self.number:
            tables = list(_read(f"{self.index.path}/blocks/block={number}"))
            self.ids = np.concatenate([t.column("ids").combine_chunks().flatten().to_numpy() for t in tables])
            self.matrix = np.concatenate([_rows_of(t.column("vectors"), self.index.dim) for t in tables])
            order = np.argsort(self.ids, kind="stable")
            self.ids, self.matrix, self.number = self.ids[order], self.matrix[order], number
        cosines = np.round(units @ self.matrix.T, DECIMALS)
        place = cosines.argmax(axis=1)
        return cosines[np.arange(len(place)), place], self.ids[place]


# ---------------------------------------------------------------- build

def build_index(bank: DataFrame, column: str, path: str, encoder: Encoder | None = None, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> ExampleIndex:
    """Writes the index of ``bank(idx, column)`` below the new folder ``path``; an example without an index comes behind all others."""
    spark = bank.sparkSession

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rows = _units(batch.column(1), encoder, "example ")
            vectors = _binary(units)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors if rows is None else vectors.take(pa.array(rows))], names=["idx", "vector"])

    given = bank.select(F.coalesce(F.col("idx").cast("bigint"), F.lit(LAST)).alias("idx"), column)
    given.mapInArrow(unit, VECTORS).groupBy("vector").agg(F.min("idx").alias("idx")).write.parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    size = F.octet_length("vector")
    lowest, blank, n, small, large = vectors.agg(
        F.min("idx"), F.min(F.when(size == 0, F.col("idx"))), F.count(F.when(size > 0, 1)), F.min(F.when(size > 0, size)), F.max(size)).first()
    lowest, blank = (LAST if x is None else x for x in (lowest, blank))
    if not n:
        return ExampleIndex(path, 0, np.empty((0, 0)), lowest, blank)
    if small != large:
        raise ValueError(f"example vectors of different sizes: {small // 8}, {large // 8}")
    cells = min(MOST_CELLS, -(-n // cell_rows))
    picked = vectors.filter(size > 0).orderBy(F.xxhash64("vector"), "idx").limit(cells).select("vector").collect()
    index = ExampleIndex(path, small // 8, np.stack([np.frombuffer(r["vector"]) for r in picked]), lowest, blank)
    slices = max(1, 4 * n // (cells * block_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = _distances(_rows_of(batch.column("vector"), index.dim), index.pivots)
                cell = distances.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("idx"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(distances[np.arange(len(cell)), cell])],
                    names=["idx", "vector", "cell", "distance"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            units, cell = _rows_of(rows.column("vector"), index.dim), rows.column("cell")[0].as_py()
            distances = _distances(units, index.pivots[[*range(min(REFERENCES, len(index.pivots))), cell]])
            return pa.RecordBatch.from_arrays(
                [pa.array([made - 1]), pa.array([cell], pa.int32()), pa.array([rows.column("idx").to_pylist()], pa.list_(pa.int64())),
                 pa.array([units.tobytes()], pa.binary()), pa.array([distances.min(axis=0).tolist()]), pa.array([distances.max(axis=0).tolist()])],
                names=["block", "cell", "ids", "vectors", "least", "greatest"])

        def key(rows: pa.Table) -> tuple:
            return rows.column("cell")[0].as_py(), rows.column("slice")[0].as_py()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column("cell").to_numpy().astype(np.int64), table.column("slice").to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            for begin, end in zip(edges, edges[1:]):
                at = begin
                while at < end:
                    if held and (key(held[0]) != tuple(keys[:, at].tolist()) or sum(t.num_rows for t in held) == block_rows):
                        yield block(pa.concat_tables(held))
                        held = []
                    part = table.slice(at, min(end - at, block_rows - sum(t.num_rows for t in held)))
                    held.append(part)
                    at += part.num_rows
        if held:
            yield block(pa.concat_tables(held))

    placed = vectors.filter(size > 0).select("idx", "vector").mapInArrow(place, PLACED)
    sliced = placed.withColumn("slice", F.floor(F.col("distance") / 2 * slices))
    dealt = sliced.hint("rebalance", "cell", "slice").sortWithinPartitions("cell", "slice", "distance", "idx")
    blocks = dealt.mapInArrow(cut, BLOCKS)
    blocks.write.partitionBy("block").parquet(f"{path}/blocks")
    written = spark.read.schema("cell int, least array<double>, greatest array<double>, block bigint").parquet(f"{path}/blocks")
    written.select("block", "cell", "least", "greatest").write.parquet(f"{path}/directory")
    return index


# ---------------------------------------------------------------- search

def _tables(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_rows:
            yield batch, *(batch.column(batch.schema.get_field_index(n)) for n in names)


def search_index(targets: DataFrame, index: ExampleIndex, column: str, encoder: Encoder | None = None, pairs: Accumulator | None = None) -> DataFrame:
    """Adds ``max_similarity_score`` and ``most_similar_positive_idx`` to the targets.

    ``pairs`` counts the compared pairs of distinct targets and examples.
    """
    if index.empty:
        return targets.withColumns({"max_similarity_score": F.lit(0.0), "most_similar_positive_idx": F.lit(None).cast("bigint")})
    keys = targets.select(F.col(column).alias("_key")).distinct()
    found = keys.schema.simpleString()[len("struct<_key:"):-1]
    shape = f"_key {found}, {FOUND}"
    names = ["_key", *(x.split()[0] for x in FOUND.split(", "))]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(index) if index.dim else None
        for batch, values in _tables(batches, "_key"):
            units, rows = _units(values, encoder, "")
            rows = np.arange(len(units)) if rows is None else rows
            turned = units.any(axis=1)
            if index.dim and turned.any() and units.shape[1] != index.dim:
                raise ValueError(f"example vectors have {index.dim} numbers, others {units.shape[1]}")
            homes, score, idx = np.full(len(units), -1), np.zeros(len(units)), np.full(len(units), index.lowest)
            if index.blank == LAST and index.dim:
                score[turned] = -np.inf
            idx[turned] = index.blank
            if index.dim and turned.any():
                homes[turned] = directory.homes(units[turned])
            block = pa.array(homes[rows], pa.int64(), mask=homes[rows] < 0)
            yield pa.RecordBatch.from_arrays(
                [values, _binary(units).take(pa.array(rows)), block, pa.nulls(len(block), pa.int64()), pa.array(score[rows]), pa.array(idx[rows])], names=names)

    def compare(batches: Iterator[pa.RecordBatch], follow: bool) -> Iterator[pa.RecordBatch]:
        directory, blocks = Directory(index) if index.dim else None, Blocks(index)
        for batch, key, vector, block, which, score, idx in _tables(batches, *names):
            score, idx = score.to_numpy(zero_copy_only=False).copy(), idx.to_numpy(zero_copy_only=False).copy()
            asked = np.flatnonzero(block.is_valid().to_numpy(zero_copy_only=False))
            numbers, marks = (x.fill_null(0).to_numpy(zero_copy_only=False)[asked] for x in (block, which))
            units = _rows_of(vector.take(pa.array(asked)), index.dim) if len(asked) else np.empty((0, index.dim))
            for number in np.unique(numbers).tolist():
                here = np.flatnonzero(numbers == number)
                # A home is a block, what follows is a group with marks.
                for one, places in [(number, np.arange(len(here)))] if follow else directory.marked(number, marks[here]):
                    mine = here[places]
                    for at in range(0, len(mine), 512):
                        part = mine[at:at + 512]
                        top, first = blocks.best(one, units[part])
                        rows = asked[part]
                        better = (top > score[rows]) | ((top == score[rows]) & (first < idx[rows]))
                        score[rows], idx[rows] = np.where(better, top, score[rows]), np.where(better, first, idx[rows])
                        if pairs is not None:
                            pairs.add(len(part) * len(blocks.ids))
            nothing = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([key, pa.nulls(len(key), pa.binary()), nothing, nothing, pa.array(score), pa.array(idx)], names=names)
            if follow and len(asked):
                rows, groups, marks = directory.grouped(*directory.left(units, numbers, score[asked]))
                for at in range(0, len(rows), 10_000):
                    part = rows[at:at + 10_000]
                    where = pa.array(asked[part])
                    yield pa.RecordBatch.from_arrays(
                        [key.take(where), vector.take(where), pa.array(groups[at:at + 10_000]), pa.array(marks[at:at + 10_000]),
                         pa.array(score[asked[part]]), pa.array(idx[asked[part]])], names=names)

    def by_block(rows: DataFrame, follow: bool) -> DataFrame:
        dealt = rows.hint("rebalance", "block").sortWithinPartitions("block")
        return dealt.mapInArrow(lambda batches: compare(batches, follow), shape)

    merged = by_block(by_block(keys.mapInArrow(start, shape), True), False)
    best = merged.groupBy("_key").agg(F.max(F.struct("score", (-F.col("idx")).alias("behind"))).alias("_best"))
    idx = -F.col("_best.behind")
    named = best.select(
        "_key", F.when(F.isnan("_best.score") | (F.col("_best.score") == float("-inf")), 0.0).otherwise(F.col("_best.score")).alias("max_similarity_score"),
        F.when(idx != LAST, idx).alias("most_similar_positive_idx"))
    return targets.join(named, targets[column].eqNullSafe(named["_key"]), "left").drop("_key")


def nearest(targets: DataFrame, bank: DataFrame, column: str, path: str, *, encoder: Encoder | None = None, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """The nearest example of every target: one narrow scan of a bank of up to ``scan_rows`` examples, else the index."""
    if len(bank.select("idx").limit(scan_rows + 1).collect()) <= scan_rows:
        return nearest_example(targets, bank, column, path, encoder=encoder)
    return search_index(targets, build_index(bank, column, path, encoder), column, encoder)
