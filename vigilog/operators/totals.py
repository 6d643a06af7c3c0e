"""Totals that grow by the files that arrive.

A store keeps a ledger of the files that were counted, and one set of partial totals for every run. A run lists the input, reads
only files (path, size, time of change) that the ledger does not have, counts them, and writes their totals, then the
ledger's new rows, which is what makes the run count: totals without a ledger row, as a run that broke off leaves
them, are never read. Counts add up in any order, so files with late lines need nothing special. ``compact`` brings
the partial totals of many runs down to those of one, whose ledger row names the runs it stands for.

Deleted files stay counted. A file that changed would be counted again, so inputs must be files that are written once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run string, path string, size bigint, changed timestamp, replaces array<string>"
LISTED = ["path", "size", "changed"]


def _ledger(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    except AnalysisException:  # the first run
        return spark.createDataFrame([], LEDGER)


def _listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def add_new_files(
    spark: SparkSession, path: str | Sequence[str], store: str, read: Callable[[list[str]], DataFrame], keys: Callable[[DataFrame], DataFrame]
) -> list[str]:
    """Counts the files below ``path`` that are new, by the columns that ``keys`` makes of what ``read`` gives for them; the files read.

    Runs of one store must not overlap.
    """
    new = _listing(spark, path).join(_ledger(spark, store), LISTED, "left_anti").orderBy("path").collect()
    if not new:
        return []
    run, names = uuid.uuid4().hex, [r["path"] for r in new]
    keyed = keys(read(names))
    keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("events")).write.parquet(f"{store}/totals/run={run}")
    _append(spark, store, [(run, *r, None) for r in new])
    return names


def _append(spark: SparkSession, store: str, rows: list[tuple]) -> None:
    """One file, so that it is there as a whole or not at all."""
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{store}/ledger")


def _live(spark: SparkSession, store: str) -> list[str]:
    """The finished runs that no other run stands for."""
    ledger = _ledger(spark, store)
    replaced = ledger.select(F.explode("replaces").alias("run"))
    return [r["run"] for r in ledger.select("run").distinct().join(replaced, "run", "left_anti").orderBy("run").collect()]


def totals(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The keys and their ``events`` over all files counted; ``schema`` names the columns (keys, then ``events bigint``)."""
    paths = [f"{store}/totals/run={run}" for run in _live(spark, store)]
    parts = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    keys = [c for c in parts.columns if c != "events"]
    return parts.groupBy(*keys).agg(F.sum("events").alias("events"))


def compact(spark: SparkSession, store: str, schema: str) -> None:
    """Writes the totals so far as those of one run, which takes the place of all others."""
    live = _live(spark, store)
    if len(live) > 1:
        run = uuid.uuid4().hex
        totals(spark, store, schema).write.parquet(f"{store}/totals/run={run}")
        _append(spark, store, [(run, None, None, None, live)])
