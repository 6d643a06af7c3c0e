"""The alert with a state of its own: equal to the batch search, bounded, and going on after a restart."""

import datetime as dt
import json
import random

import pytest

from vigilog.operators import searches
from vigilog.session import scratch_path
from vigilog.streaming import alerts
from vigilog.streaming import searches as streams

SCHEMA = "line_id bigint, ts timestamp, line string"
START = dt.datetime(2025, 3, 1)


def line(user, ip):
    return f"sshd[1]: failed login for user={user} from 10.0.0.{ip}"


def arrivals(n=4, per=150):
    """Files whose lines follow each other in time, some failures in bursts."""
    r, now, out = random.Random(2), START, []
    for k in range(n):
        rows = []
        for i in range(per):
            now += dt.timedelta(seconds=r.choice([5, 20, 600]))
            rows.append((k * per + i, now, r.choice([line("bob", 1), line("bob", 2), line("eve", 1), "kernel: up", "failed login without names"])))
        rows.append((10_000 + k, None, line("bob", 1)))
        out.append(rows)
    return out


def run(spark, source, path, limit):
    stream = alerts.alert_state_stream(streams.parquet_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, 1), limit=limit)
    query = streams.start_to_files(stream, path, path + "-checkpoint")
    query.awaitTermination()
    return query


def rows(df):
    return sorted((r["window_start"], r["window_end"], r["src_ip"], r["user"], r["failures"]) for r in df.collect())


@pytest.mark.parametrize("limit", [0, 5])
def test_equals_the_batch_search_and_goes_on_after_a_restart(spark, limit):
    source, path = scratch_path(spark, "alert-source"), scratch_path(spark, "alerts")
    files = arrivals()
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k == 0:
            continue  # the first run sees two files, every other one restarts with one more
        query = run(spark, source, path, limit)
        given = [r for f in files[:k + 1] for r in f]
        last = max(r[1] for r in given if r[1] and "user=" in r[2])
        batch = searches.failed_login_alert(spark.createDataFrame(given, SCHEMA), "1 hour", "30 minutes", limit)
        closed = batch.filter(f"window_end <= timestamp'{last - dt.timedelta(hours=1)}'")
        found = spark.read.schema("window_start timestamp, window_end timestamp, src_ip string, user string, failures bigint").parquet(path)
        assert rows(found) == rows(closed)
    assert rows(found)
    # What is kept: the slots and timers of the last hours of three keys, however many went by.
    state = json.loads(query.lastProgress.json)["stateOperators"][0]
    assert state["numRowsTotal"] <= 3 * (2 + 2) * 4


def test_windows_must_be_multiples(spark):
    with pytest.raises(ValueError):
        alerts.alert_state_stream(spark.createDataFrame([], SCHEMA), window=3600, slide=1000)


def test_no_python_for_keys_slots_and_timers(spark):
    """A call for each key and timer made the run grow to hours; Spark's own aggregations keep the state."""
    stream = alerts.alert_state_stream(streams.parquet_stream(spark, scratch_path(spark, "nothing") + "*", spark.createDataFrame([], SCHEMA).schema, 1))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Aggregate [") == 2
