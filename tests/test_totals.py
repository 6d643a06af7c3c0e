"""Totals over arriving files equal a recount and read new files only."""

import pytest
from pyspark.sql import functions as F

from vigilog.operators import totals

SCHEMA = "hour timestamp, event_category string, events bigint"


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in"), str(tmp_path / "store")


def write(folder, name, lines):
    with open(f"{folder}/{name}", "w") as out:
        out.write("\n".join(lines) + "\n")


def keys(lines):
    ts = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.select(F.date_trunc("hour", ts).alias("hour"), F.when(F.col("value").contains("failed"), "failure").alias("event_category"))


def run(spark, folder, store):
    return totals.add_new_files(spark, folder, store, lambda names: spark.read.text(names), keys)


def same_as_recount(spark, folder, store):
    counted = keys(spark.read.text(folder)).groupBy("hour", "event_category").agg(F.count(F.lit(1)).alias("events"))
    found = totals.totals(spark, store, SCHEMA)
    assert sorted(map(str, found.collect())) == sorted(map(str, counted.collect()))


def test_three_arrivals(spark, place):
    folder, store = place
    assert totals.add_new_files(spark, folder, store, lambda names: spark.read.text(names), keys) == []
    assert totals.totals(spark, store, SCHEMA).collect() == []
    write(folder, "a.log", ["2025-01-01 10:00:00 failed", "2025-01-01 10:30:00 ok", "no time"])
    assert len(run(spark, folder, store)) == 1
    same_as_recount(spark, folder, store)
    write(folder, "b.log", ["2025-01-01 11:00:00 failed"] * 3)
    write(folder, "c.log", ["2025-01-01 11:00:00 failed"] * 3)  # equal contents, another file
    read = []
    found = totals.add_new_files(spark, folder, store, lambda names: read.extend(names) or spark.read.text(names), keys)
    assert sorted(n.rsplit("/", 1)[1] for n in read) == ["b.log", "c.log"] and read == found
    same_as_recount(spark, folder, store)
    totals.compact(spark, store, SCHEMA)
    same_as_recount(spark, folder, store)
    write(folder, "late.log", ["2025-01-01 10:59:59 failed", "2024-12-31 23:00:00 ok"])
    assert [n.rsplit("/", 1)[1] for n in run(spark, folder, store)] == ["late.log"]
    same_as_recount(spark, folder, store)
    totals.compact(spark, store, SCHEMA)
    assert run(spark, folder, store) == []
    same_as_recount(spark, folder, store)
    assert len(totals._live(spark, store)) == 1


def test_a_run_that_broke_off_does_not_count(spark, place):
    folder, store = place
    write(folder, "a.log", ["2025-01-01 10:00:00 failed"])
    lost = spark.createDataFrame([(None, "failure", 99)], SCHEMA)
    lost.write.parquet(f"{store}/totals/run=lost")  # its ledger row was never written
    run(spark, folder, store)
    same_as_recount(spark, folder, store)


def test_a_failing_count_leaves_the_store_as_it_was(spark, place):
    folder, store = place
    write(folder, "a.log", ["2025-01-01 10:00:00 failed"])
    with pytest.raises(Exception, match="broken"):
        totals.add_new_files(spark, folder, store, lambda names: spark.read.text(names), lambda df: df.select(F.raise_error(F.lit("broken")).alias("hour")))
    assert len(run(spark, folder, store)) == 1
    same_as_recount(spark, folder, store)
