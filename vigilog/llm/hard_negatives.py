"""Hard negatives from exact integer scores.

For each anchor and each of its best positives (rows of its label) the best rows of other labels are wanted
whose score lies in a window below the positive's. Scores are inner products of
integer vectors:

* Tiles. Vectors are stored once, in files of at most TILE numbers' worth of rows, and read by Spark, a tile at a time.
  The anchors are stored apart; a task reads them block by block for each of its tiles, so neither side is ever
  held whole. The work is anchors x rows, as the anchors are a stated query set.
* Strassen. A tile of scores is a product of an anchor block and a candidate block: both are padded with zeros to even sizes and
  split into quarters, seven products of sums and differences replace eight. Sums of int64 are exact, as overflow
  in between cancels out; products below LEAF in some dimension go to float64 where every
  partial sum stays below 2^53, else to int64.
* Heaps. A first pass keeps the best positives of every anchor, a second one the best rows in every
  (anchor, positive) window. What a task keeps is merged from tile to tile, then between tasks, and holds a
  fixed number of entries for each anchor; a score that cannot enter a full heap is dropped in the tile.

Defined cases: rows without id or label, without a vector, or with a null, NaN or infinite component take no part; of rows
with one id the least (label, vector) counts; shorter vectors are filled up with zeros; ties go to the smaller id; without
anchors, positives or rows in a window there are no rows; other columns are not read. Components whose scores
could leave 64 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import shared_path, stored

#: Numbers in a tile of candidates and in an anchor block.
TILE = 1 << 23
BLOCK = 1 << 15
#: Candidates scored at once.
COLUMNS = 4096
LEAF = 32
LEAST = np.iinfo(np.int64).min
FOUND = "anchor_id bigint, slot int, candidate_id bigint, score bigint"


# ---------------------------------------------------------------- products

def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product of int64 matrices, in floats where these are exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(matrix: np.ndarray) -> np.ndarray:
    return np.pad(matrix, ((0, matrix.shape[0] % 2), (0, matrix.shape[1] % 2)))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return _plain(a, b)
    a, b = _even(a), _even(b)
    r, d, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :d], a[:r, d:], a[r:, :d], a[r:, d:]
    b11, b12, b21, b22 = b[:d, :c], b[:d, c:], b[d:, :c], b[d:, c:]
    out = np.empty((2 * r, 2 * c), np.int64)
    top, right, left, low = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    top[:], low[:] = both, both
    part = strassen(a21 + a22, b11, leaf)
    left[:] = part
    low -= part
    part = strassen(a11, b12 - b22, leaf)
    right[:] = part
    low += part
    part = strassen(a22, b21 - b11, leaf)
    left += part
    top += part
    part = strassen(a11 + a12, b22, leaf)
    right += part
    top -= part
    low += strassen(a21 - a11, b11 + b12, leaf)
    top += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


# ---------------------------------------------------------------- heaps

class Heaps:
    """The best ``size`` (score, id) of each of ``n`` heaps; ids must come in rising order."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.heap, self.score, self.ident = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, LEAST)  # a score must be above it to enter

    def add(self, heap: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        heap, score, ident = (np.concatenate(x) for x in ((self.heap, heap), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, heap))
        heap = heap[order]
        place = np.arange(len(heap)) - np.searchsorted(heap, heap)
        kept = place < self.size
        self.heap, self.score, self.ident = heap[kept], score[order][kept], ident[order][kept]
        last = place[kept] == self.size - 1
        self.least[self.heap[last]] = self.score[last]


# ---------------------------------------------------------------- blocks of vectors

def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if held and n + part.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stored_tables(path: str, rows: int) -> Iterator[pa.Table]:
    """The rows of a stored table, a block at a time."""
    system, base = pyarrow.fs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")):
        yield from _tables(pq.ParquetFile(system.open_input_file(file)).iter_batches(rows), rows)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _found(ids: np.ndarray, slots: int, heaps: Heaps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[heaps.heap // slots]), pa.array((heaps.heap % slots).astype(np.int32)), pa.array(heaps.ident), pa.array(heaps.score)],
        names=["anchor_id", "slot", "candidate_id", "score"])


def positive_heaps(anchors: pa.Table, tile: pa.Table, dim: int, size: int) -> pa.RecordBatch:
    """The best rows of each anchor's label in a tile; the tile is sorted by id."""
    ids, labels, matrix = _numbers(anchors, "vec_id"), _numbers(anchors, "label"), _matrix(_column(anchors, "vector"), dim)
    others, classes, columns = _numbers(tile, "vec_id"), _numbers(tile, "label"), _matrix(_column(tile, "vector"), dim)
    heaps = Heaps(len(ids), size)
    for label in np.unique(labels):
        rows, mates = np.flatnonzero(labels == label), np.flatnonzero(classes == label)
        for at in range(0, len(mates), COLUMNS):
            part = mates[at:at + COLUMNS]
            scores = strassen(matrix[rows], columns[part].T)
            good = (scores > heaps.least[rows][:, None]) & (ids[rows][:, None] != others[part])
            r, c = np.nonzero(good)
            heaps.add(rows[r], scores[r, c], others[part][c])
    return _found(ids, 1, heaps)


def window_heaps(anchors: pa.Table, tile: pa.Table, dim: int, slots: int, size: int, low: int, high: int) -> pa.RecordBatch:
    """The best rows of other labels in the window of each positive of each anchor; the tile is sorted by id."""
    ids, labels, matrix = _numbers(anchors, "vec_id"), _numbers(anchors, "label"), _matrix(_column(anchors, "vector"), dim)
    others, classes, columns = _numbers(tile, "vec_id"), _numbers(tile, "label"), _matrix(_column(tile, "vector"), dim)
    sizes = pc.list_value_length(_column(anchors, "positives")).to_numpy(zero_copy_only=False)
    there = np.arange(slots) < sizes[:, None]
    positive = np.zeros((len(ids), slots), np.int64)
    positive[there] = pc.list_flatten(_column(anchors, "positives")).to_numpy(zero_copy_only=False)
    # low * positive <= 100 * score <= high * positive
    least = np.where(there, -((-low * positive) // 100), np.iinfo(np.int64).max)
    most = np.where(there, (high * positive) // 100, LEAST)
    heaps = Heaps(len(ids) * slots, size)
    for at in range(0, len(others), COLUMNS):
        scores = strassen(matrix, columns[at:at + COLUMNS].T)
        enter = np.maximum(least, np.where(heaps.least == LEAST, LEAST, heaps.least + 1).reshape(-1, slots))
        some = (scores >= enter.min(axis=1)[:, None]) & (scores <= most.max(axis=1)[:, None])
        r, c = np.nonzero(some & (labels[:, None] != classes[at:at + COLUMNS]))
        score, ident = scores[r, c], others[at:at + COLUMNS][c]
        for slot in range(slots):
            inside = (score >= enter[r, slot]) & (score <= most[r, slot])
            heaps.add(r[inside] * slots + slot, score[inside], ident[inside])
    return _found(ids, slots, heaps)


# ---------------------------------------------------------------- the tables

def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: components as floor(scale x component), rows that take part only."""
    floats = F.col("vector").cast("array<double>")
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), floats.alias("vector"))
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fit)
    return kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x * float(scale))))


def _best(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The heaps of all tasks merged, with the rank of every entry."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tile: int = TILE, block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``vec_id, label, vector`` as ``integer_vectors`` gives it. Negatives satisfy
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = vectors.sparkSession
    size = F.size("vector")
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    n, dim, largest = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.max(most), F.lit(0.0))).first()
    if largest * largest * dim >= 2.0**62:
        raise ValueError(f"scores of components up to {largest} leave 64 bits")
    tile_rows, block_rows = max(tile // max(dim, 1), 1), max(block // max(dim, 1), 1)
    files = max(spark.sparkContext.defaultParallelism, -(-n // tile_rows))
    one = vectors.repartition(files, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_one"))
    # Sorted by id, so the ids of a file come in rising order.
    rows = stored(one.select("vec_id", "_one.*").sortWithinPartitions("vec_id"), "vectors")
    anchors = rows.filter(is_anchor)

    def scored(queries: DataFrame, heaps) -> DataFrame:
        path = shared_path(spark, "anchors")
        stored(queries, "anchors", path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in _tables(batches, tile_rows):
                in_order = whole.sort_by("vec_id")
                for part in _stored_tables(path, block_rows):
                    yield heaps(part, in_order)

        return rows.mapInArrow(run, FOUND)

    first = scored(anchors, lambda a, t: positive_heaps(a, t, dim, positives))
    best = stored(_best(first, ["anchor_id"], positives).select("anchor_id", F.col("candidate_id").alias("positive_id"), "score", "rank"), "positives")
    lists = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
    asked = anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    second = scored(asked, lambda a, t: window_heaps(a, t, dim, positives, negatives, low, high))
    mined = _best(second, ["anchor_id", "slot"], negatives)
    named = best.select("anchor_id", "positive_id", F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot"))
    return mined.join(named, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("candidate_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negative_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings(vec_id, embedding, label)``: every hundredth id is an anchor, every seventh has the next label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = embeddings.select("vec_id", shifted.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(integer_vectors(vectors), F.col("vec_id") % 100 == 0)
