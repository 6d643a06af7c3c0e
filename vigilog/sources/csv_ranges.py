"""Records of CSV files, a large file in many tasks.

A quoted cell may hold line breaks, so where a record begins depends on all quotes before it. Spark reads the input as plain
lines, in byte ranges of its own choice, twice:

1. every range gives the parity of its quotes and whether its bytes are UTF-8; parities summed up over the ranges of a file (a row
   for each range) tell in which ranges a record of an earlier one goes on;
2. every range then puts its lines together to records where it is. A record that crosses the end of a range leaves
   fragments, one in each range it touches; only those are brought together.

The records go through Spark's own CSV parser, one expression for each number of columns that a header has. Rows carry the
names of their own file's header. As in any reader that splits files, quotes that are no quoting (``5" disk``) must not stand in the
files, or come in pairs.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.session import scratch_path

SPLIT = ["source", "_start"]
PARTS = "source string, _start bigint, _at bigint, part binary, begins boolean, ends boolean, first boolean"
OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _odd_quotes():
    return ((F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit('"'), F.lit("")))) % 2).cast("tinyint")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARTS of lines that come range by range, in order."""
    key, parity, held, begun, named = None, 0, [], None, False

    def part(begins: bool, ends: bool, at: int, first: bool) -> pa.RecordBatch:
        values = [[key[0]], [key[1]], [at], [b"\n".join(held)], [begins], [ends], [first]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in PARTS.split(", ")])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield part(begun is not None, False, held_at, first_held)

    held_at, first_held = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("source").dictionary_encode()
        places = np.stack([codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column("_start").to_numpy()])
        edges = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            rows = batch.slice(begin, end - begin)
            now = (rows.column("source")[0].as_py(), rows.column("_start")[0].as_py())
            if now != key:
                yield from rest()
                key, held, begun, named = now, [], None, now[1] != 0
                parity = int(bool(rows.column("_inside")[0].as_py()))
            after = (parity + np.cumsum(rows.column("_odd").to_numpy(zero_copy_only=False).astype(np.int64))) % 2
            before = np.concatenate([[parity], after[:-1]])
            parity = int(after[-1])
            whole = (before == 0) & (after == 0)
            first = np.zeros(len(after), bool)
            raw, at = rows.column("raw"), rows.column("_at")
            if not named:  # the header is the first line of the file that is not blank
                for i in np.flatnonzero(before == 0):
                    if raw[int(i)].as_py().strip():
                        first[i] = named = True
                        break
            mask = pa.array(whole)
            n = int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [rows.column("source").filter(mask), rows.column("_start").filter(mask), at.filter(mask), raw.filter(mask), pa.array(np.ones(n, bool)),
                 pa.array(np.ones(n, bool)), pa.array(first[whole])], names=[x.split()[0] for x in PARTS.split(", ")])
            for i in np.flatnonzero(~whole).tolist():
                if not before[i]:
                    held, begun, held_at, first_held = [], True, at[i].as_py(), bool(first[i])
                elif not held:
                    held_at, first_held = at[i].as_py(), False
                held.append(raw[i].as_py())
                if not after[i]:
                    yield part(begun is not None, True, held_at, first_held)
                    held, begun = [], None
    yield from rest()


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``source, place, record, first, utf8``: the records of CSV files, blank ones left out; ``first`` marks headers, ``place`` sorts."""
    raw = _lines(spark, path)
    facts = _stored(raw.groupBy(*SPLIT).agg((F.sum(_odd_quotes()) % 2).alias("odd"), F.every(F.is_valid_utf8("raw")).alias("utf8")), "csv-ranges")
    before = F.sum("odd").over(Window.partitionBy("source").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    inside = facts.withColumn("_before", F.coalesce(before, F.lit(0)) % 2).filter("_before = 1").select(*SPLIT, F.lit(True).alias("_inside"))
    # No hint: there is a row for each range that begins inside a cell, and Spark checks their size.
    marked = raw.select("*", _odd_quotes().alias("_odd")).withColumn("raw", F.col("raw").cast("binary")).join(inside, SPLIT, "left")
    parts = _stored(marked.sortWithinPartitions(*SPLIT, "_at").mapInArrow(_assemble, PARTS), "csv-parts")
    place = F.struct("_start", "_at").alias("place")
    whole = parts.filter("begins AND ends").select("source", place, F.col("part").cast("string").alias("record"), "first")
    pieces = parts.filter("NOT (begins AND ends)")
    chain = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("source").orderBy("_start", "_at"))
    joined = pieces.withColumn("_chain", chain).groupBy("source", "_chain").agg(
        F.min(F.struct("_start", "_at")).alias("place"),
        F.array_sort(F.collect_list(F.struct("_start", "_at", F.col("part").cast("string").alias("part")))).alias("_parts"), F.bool_or("first").alias("first"))
    crossing = joined.select("source", "place", F.array_join(F.transform("_parts", lambda x: x["part"]), "\n").alias("record"), "first")
    records = whole.unionByName(crossing).withColumn("record", F.rtrim(F.col("record"), F.lit("\r"))).filter(F.length(F.trim("record")) > 0)
    utf8 = facts.groupBy("source").agg(F.bool_and("utf8").alias("utf8"))
    return records.join(utf8, "source")


def csv_rows(spark: SparkSession, path: str | Sequence[str], encoding: str = "auto") -> DataFrame:
    """``source, place, names, cells, wide``: the rows of CSV files by their own headers; ``wide`` rows have more cells than names.

    Files that are not UTF-8 are read as ISO-8859-1 (``auto``), or all are in the given encoding. The driver sees each different header once.
    """
    records = csv_records(spark, path)
    latin = F.decode(F.col("record").cast("binary"), "ISO-8859-1")
    if encoding.lower() in ("iso-8859-1", "latin-1"):
        records = records.withColumn("record", latin)
    elif encoding == "auto":
        records = records.withColumn("record", F.when(F.col("utf8"), F.col("record")).otherwise(latin))
    first = records.filter("first").select("source", F.regexp_replace("record", "^\ufeff", "").alias("_header"))
    csv.field_size_limit((1 << 31) - 1)
    headers = [(r["_header"], next(csv.reader([r["_header"]]))) for r in first.select("_header").distinct().collect()]
    if not headers:
        return spark.createDataFrame([], "source string, place struct<_start:bigint,_at:bigint>, names array<string>, cells array<string>, wide boolean")
    names = spark.createDataFrame([(h, n) for h, n in headers], "_header string, names array<string>")
    named = records.filter("NOT first").join(first.join(F.broadcast(names), "_header").select("source", "names"), "source")
    cells, wide = F, F
    for width in sorted({len(n) for _, n in headers}):
        columns = [f"_c{i}" for i in range(width)]
        parsed = F.from_csv("record", ", ".join(f"{c} string" for c in [*columns, "_broken"]), OPTIONS)
        here = F.size("names") == width
        cells = cells.when(here, F.array(*(parsed[c] for c in columns)))
        # A short row is broken as well, but leaves the last cell empty.
        wide = wide.when(here, parsed["_broken"].isNotNull() & parsed[columns[-1]].isNotNull())
    return named.select("source", "place", "names", cells.alias("cells"), wide.alias("wide"))
