"""Distinct entities and frequent entities from small summaries.

Distinct counts: a HyperLogLog sketch for each type of entity and hour, written once. Any span of hours is answered
by merging its sketches; the lines are not read again.

Frequent values, exactly, in two passes. In the first each task keeps at most ``capacity`` counters a group; when they run out it
lowers all of them and remembers by how much (Misra and Gries). The counters of all tasks add up to counts that
are too low by at most the sum of what was taken off. Whatever may still be among the first ``n`` is a candidate,
and the second pass counts candidates only. If the last of the ``n`` found is above what any other value can have, the
answer is proved; groups where it is not (values of nearly one frequency) are counted in full. What the first pass
shuffles depends on the number of tasks, not of values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.operators.ranking import first_rows_per
from vigilog.session import scratch_path

LG_K = 14
CAPACITY = 10_000
COUNTERS = "grp string, value string, counted bigint, lowered bigint"


# ---------------------------------------------------------------- distinct counts

def write_sketches(entities: DataFrame, path: str, lg_k: int = LG_K) -> None:
    """Writes one sketch for each ``type, hour`` of ``entities(type, hour, entity)``; rows without entity do not count."""
    sketches = entities.filter("entity IS NOT NULL").groupBy("type", "hour").agg(F.hll_sketch_agg("entity", lg_k).alias("sketch"))
    sketches.write.mode("append").parquet(path)


def distinct_from_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The keys with ``unique_entities``: an estimate for the union of all sketches of each."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("_sketch"))
    return merged.select(*keys, F.hll_sketch_estimate("_sketch").alias("unique_entities"))


# ---------------------------------------------------------------- frequent values

class Counters:
    """At most ``capacity`` counters of one group."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.lowered = capacity, {}, 0

    def add(self, values: Sequence[str], counts: Sequence[int]) -> None:
        for value, n in zip(values, counts):
            self.counts[value] = self.counts.get(value, 0) + n
            if len(self.counts) > 2 * self.capacity:
                self.lower()

    def lower(self) -> None:
        """Takes as much off every counter as leaves no more than ``capacity``."""
        if len(self.counts) > self.capacity:
            off = int(-np.partition(-np.fromiter(self.counts.values(), np.int64), self.capacity)[self.capacity])
            self.counts = {v: n - off for v, n in self.counts.items() if n > off}
            self.lowered += off


def counters(rows: DataFrame, capacity: int) -> DataFrame:
    """COUNTERS of ``rows(grp, value)`` by task; a row with a null value says how much a task took off a group's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, Counters] = {}
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["grp", "value"]).aggregate([([], "count_all")])
            for grp in pc.unique(sums.column("grp")).to_pylist():
                part = sums.filter(pc.equal(sums.column("grp"), grp))
                groups.setdefault(grp, Counters(capacity)).add(part.column("value").to_pylist(), part.column("count_all").to_pylist())
        for grp, own in groups.items():
            own.lower()
            values = [None, *own.counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(values), pa.string()), pa.array(values, pa.string()), pa.array([0, *own.counts.values()], pa.int64()),
                 pa.array([own.lowered] + [0] * (len(values) - 1), pa.int64())], names=["grp", "value", "counted", "lowered"])

    return rows.select(F.col("grp").cast("string"), F.col("value").cast("string")).mapInArrow(run, COUNTERS)


def most_frequent(
    rows: DataFrame, n: int, first: Column | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """``grp, value, events, rank``: the ``n`` most frequent values of every group of ``rows(grp, value, ...)``, exactly.

    Values of equal count come in the order of the least ``first`` of their rows, then by name. Rows without group or value do not count.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"grp": F.col("grp").cast("string"), "value": F.col("value").cast("string")}).filter("grp IS NOT NULL AND value IS NOT NULL")
    path = scratch_path(spark, "counters")
    found = counters(rows, capacity).groupBy("grp", "value").agg(F.sum("counted").alias("least"), F.sum("lowered").alias("off"))
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    off = found.filter("value IS NULL").select("grp", "off")
    known = found.filter("value IS NOT NULL").select("grp", "value", "least")
    # The n-th largest of the lower bounds; what may reach it is a candidate.
    last = first_rows_per(known, ["grp"], [F.desc("least"), "value"], n).groupBy("grp").agg(F.min("least").alias("nth"), F.count(F.lit(1)).alias("filled"))
    limits = off.join(last, "grp", "left").withColumn("nth", F.when(F.col("filled") >= n, F.col("nth")).otherwise(0))
    candidates = known.join(limits, "grp").filter("least + off >= nth").select("grp", "value")
    order = F.min(first) if first is not None else F.lit(0)

    def counted(part: DataFrame) -> DataFrame:
        counts = part.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("events"), order.alias("_first"))
        return first_rows_per(counts, ["grp"], [F.desc("events"), "_first", "value"], n, out="rank")

    exact = counted(rows.join(candidates, ["grp", "value"], "left_semi"))
    kept = scratch_path(spark, "frequent")
    exact.write.parquet(kept)
    exact = spark.read.schema(exact.schema).parquet(kept)
    # Others have at most ``off`` rows: fewer than the last one found, or there are none.
    lowest = exact.groupBy("grp").agg(F.min("events").alias("lowest"), F.count(F.lit(1)).alias("found"))
    proved = (F.col("off") == 0) | ((F.col("lowest") > F.col("off")) & (F.col("found") == n))
    open_groups = limits.join(lowest, "grp", "left").filter(~F.coalesce(proved, F.lit(False))).select("grp")
    if not open_groups.isEmpty():
        full = counted(rows.join(open_groups, "grp", "left_semi"))
        exact = exact.join(open_groups, "grp", "left_anti").unionByName(full)
    return exact.select("grp", "value", "events", "rank")
