"""Exact numbering, top-k, sampling and splitting without a one-task window.

A plain ``row_number().over(partitionBy(source).orderBy(id))`` puts a whole source
into one task, and an unpartitioned one puts the whole table there. Here rows are
numbered inside small blocks of the order key, and each block adds the number of
rows before it, which comes from counts that are aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import scratch_path

BLOCK_BITS = 16
#: Spark's row ids hold the partition above this many bits of row number.
ROW_BITS = 33


def numbered(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[str | Column],
    out: str = "row_number",
) -> DataFrame:
    """Row number from 1 within ``by``, following the levels and then ``order``.

    ``levels`` cut the rows into blocks of blocks: every level is a column that the
    order sorts by first, from the coarsest to the finest, and few rows share all of
    them. A row's number is its place in its block plus the rows before the block,
    summed level by level, so no task sees more than one block or one level's list.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    # A struct is never null, so rows without a value in ``by`` form a group as well.
    group = F.struct(*by) if by else F.lit(0)
    blocked = df.withColumns({"_group": group, **dict(zip(names, levels))})
    counts = blocked.groupBy("_group", *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(1, len(names) + 1):
        outer, level = ["_group", *names[: depth - 1]], names[depth - 1]
        sums = counts if depth == len(names) else counts.groupBy(*outer, level).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*outer).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        step = sums.select(*outer, level, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_before{depth}"))
        offsets = step if offsets is None else offsets.join(step, outer)
    total = sum((F.col(f"_before{d}") for d in range(1, len(names) + 1)), F.lit(0))
    offsets = offsets.select("_group", *names, total.alias("_offset"))
    in_block = Window.partitionBy("_group", *names).orderBy(*order)
    return (
        blocked.withColumn("_in_block", F.row_number().over(in_block))
        .join(offsets, ["_group", *names])
        .withColumn(out, F.col("_offset") + F.col("_in_block"))
        .drop("_group", *names, "_in_block", "_offset")
    )


def numbered_in_ranges(df: DataFrame, order: Sequence[str | Column], out: str = "row_number", name: str = "ranges") -> DataFrame:
    """All rows numbered from 1 in ``order``, for results that are stored anyway.

    One exchange: the rows are range-partitioned, sorted and written to the shared folder with their partition and their row in
    it; the rows before each partition (a number for each, all the driver sees) are added when they are read.
    Spark picks the ranges from a sample of any sortable key, so ids need no particular spread.
    """
    path = scratch_path(df.sparkSession, name)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    kept = df.sparkSession.read.schema(ranged.schema).parquet(path)
    place = F.shiftright("_row", ROW_BITS)
    sizes = kept.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before = [(r["_range"], sum(x["n"] for x in sizes[:i])) for i, r in enumerate(sizes)]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_range bigint, _before bigint"))
    number = F.col("_before") + F.col("_row").bitwiseAND((1 << ROW_BITS) - 1) + 1
    return kept.withColumn("_range", place).join(offsets, "_range").withColumn(out, number).drop("_range", "_before", "_row")


def id_blocks(ident: Column, *bits: int) -> list[Column]:
    """Levels that cut a bigint id into blocks of 2^bits; rows without an id come first."""
    return [F.coalesce(F.shiftright(ident, b), F.lit(-1).cast("bigint")) for b in bits]


def numbered_by_id(df: DataFrame, by: Sequence[str], id_col: str, out: str = "line_number") -> DataFrame:
    """Number rows from 1 by a non-negative bigint id that is unique within ``by``.

    Three levels of 16 bits: no list of blocks, and no block, has more than 65,536 rows, however the ids are spread.
    """
    return numbered(df, by, id_blocks(F.col(id_col), 3 * BLOCK_BITS, 2 * BLOCK_BITS, BLOCK_BITS), [id_col], out)


def shuffle_key(id_col: str | Column, seed: int) -> Column:
    """Repeatable pseudo-random hex key of an id, the same under any partitioning."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")).cast("binary"))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(id_col, seed), id_col)


def shuffled_positions(df: DataFrame, id_col: str, seed: int, by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Each row's place (from 1) in the pseudo-random order, within ``by`` when given."""
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    # Hex digits are even: 4,096 blocks of 256 blocks each.
    levels = [F.coalesce(F.substring("_key", 1, n), F.lit("")) for n in (3, 5)]
    return numbered(keyed, by, levels, ["_key", id_col], out).drop("_key")


def sample_per_group(df: DataFrame, by: str, id_col: str, quota: Column, seed: int) -> DataFrame:
    """The first ``quota`` rows of each group in pseudo-random order."""
    placed = shuffled_positions(df, id_col, seed, [by], "_place")
    return placed.filter(F.col("_place") <= quota).drop("_place")


def first_rows_per(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    Filtering the row number lets Spark cut every task's rows to ``n`` per group
    before the shuffle (WindowGroupLimit), so a hot group moves only a few rows.
    """
    name = out or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if out else kept.drop(name)


def head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows overall (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def ordered_split(df: DataFrame, id_col: str, ratio: float = 0.8, out: str = "part") -> DataFrame:
    """Rows before the cut ``int(n * ratio)`` in id order are ``train``, the rest ``validation``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(total * F.lit(ratio))
    placed = numbered_by_id(df, [], id_col, "_place")
    return placed.withColumn(out, F.when(F.col("_place") <= cut, "train").otherwise("validation")).drop("_place")


def hash_split(df: DataFrame, id_col: str, tenths: int = 8, out: str = "part") -> DataFrame:
    """Split by a hash of the id: no shuffle, about ``tenths`` tenths in ``train``."""
    bucket = F.pmod(F.xxhash64(id_col), F.lit(10))
    return df.withColumn(out, F.when(bucket < tenths, "train").otherwise("validation"))
