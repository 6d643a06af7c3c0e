"""Distinct counts from sketches, and frequent values in two passes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigilog.operators import sketches


def test_merged_hours_are_near_the_exact_count(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("type"), (F.col("id") % 24).alias("hour"), (F.col("id") % 20_000 * 7).cast("string").alias("entity"))
    path = str(tmp_path / "sketches")
    sketches.write_sketches(rows.filter("hour < 12"), path)
    sketches.write_sketches(rows.filter("hour >= 12").unionAll(spark.createDataFrame([("t0", 13, None)], rows.schema)), path)
    stored = spark.read.parquet(path)
    for part in (stored, stored.filter("hour BETWEEN 3 AND 9")):
        hours = [r["hour"] for r in part.select("hour").distinct().collect()]
        exact = {r["type"]: r["n"] for r in rows.filter(F.col("hour").isin(hours)).groupBy("type").agg(F.countDistinct("entity").alias("n")).collect()}
        found = {r["type"]: r["unique_entities"] for r in sketches.distinct_from_sketches(part, "type").collect()}
        assert set(found) == set(exact) and all(abs(found[t] - exact[t]) <= 0.02 * exact[t] for t in exact)


def expected(rows, n):
    out = []
    for grp in {g for g, v, _ in rows if g and v}:
        counts = Counter(v for g, v, _ in rows if g == grp and v)
        first = {v: min(i for g, w, i in rows if g == grp and w == v) for v in counts}
        ranked = sorted(counts, key=lambda v: (-counts[v], first[v], v))[:n]
        out += [(grp, v, counts[v], k) for k, v in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("capacity", [3, 20, 10_000])
@pytest.mark.parametrize("parts", [1, 7])
def test_equals_counting_all(spark, capacity, parts):
    r = random.Random(capacity)
    rows = [("skewed", f"v{min(int(r.expovariate(0.15)), 400)}", i) for i in range(4000)]
    rows += [("flat", f"x{i % 900}", 5000 + i) for i in range(1800)]  # nothing is frequent: counted in full
    rows += [("few", "only", 9000), ("few", None, 9001), (None, "v1", 9002)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "grp string, value string, id bigint").repartition(parts)
    found = sorted(tuple(x) for x in sketches.most_frequent(frame, 5, F.col("id"), capacity).collect())
    assert found == expected(rows, 5)


def test_the_first_pass_shuffles_counters_only(spark):
    rows = spark.range(200_000).select(F.lit("g").alias("grp"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value")).repartition(4)
    found = sketches.counters(rows, 50)
    assert found.count() <= 4 * 51
    assert [tuple(x) for x in sketches.most_frequent(rows, 1, capacity=50).collect()] == [("g", "hot", 66_667, 1)]


def test_no_rows(spark):
    assert sketches.most_frequent(spark.createDataFrame([], "grp string, value string"), 3).collect() == []


def test_counters_are_too_low_by_what_was_taken_off():
    r = random.Random(1)
    values = [f"v{min(int(r.expovariate(0.1)), 200)}" for _ in range(5000)]
    own = sketches.Counters(10)
    for at in range(0, len(values), 50):
        part = Counter(values[at:at + 50])
        own.add(list(part), list(part.values()))
    own.lower()
    assert len(own.counts) <= 10
    assert all(n - own.lowered <= own.counts.get(v, 0) <= n for v, n in Counter(values).items())
