"""The failed-login alert with a state of half-hour counts.

``searches.alert_stream`` counts a failure once for every window it is in. Here each address and user keeps
counts for slots of one slide (half an hour), and an hour's window is the sum of the slots in it:

* Lines are counted by slot in each task before the shuffle, so one noisy address moves a row a task and slot.
* When the watermark passes the end of a slot, its count goes, once, to a second aggregation, which adds it to the windows that the
  slot is in. A window comes out when the watermark has passed its end, and is dropped; an alert is given if the sum is above the limit.
* A key without recent failures has no slots and no windows, and so no state.

Both aggregations are Spark's own: no Python process is called for a key, a slot or a timer.

With the watermark behind the last line, alerts equal those of the batch search for all windows that ended before it.
Lines that come so late that their slot has been dropped no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.fields import search_field
from vigilog.operators.searches import FAILURE, category_search
from vigilog.streaming.searches import WATERMARK


def slot_counts(lines: DataFrame, slide: int, watermark: str = WATERMARK) -> DataFrame:
    """``slot, src_ip, user, failures``: failures by slot of ``slide`` seconds, each slot once, when the watermark has passed it."""
    failed = category_search(lines, FAILURE).select(
        search_field(F.col("line"), "src_ip"), search_field(F.col("line"), "user"), F.col("ts").cast("timestamp").alias("ts"))
    named = failed.filter("src_ip IS NOT NULL AND user IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark)
    return named.groupBy(F.window("ts", f"{slide} seconds").alias("slot"), "src_ip", "user").agg(F.count(F.lit(1)).alias("failures"))


def alert_state_stream(lines: DataFrame, watermark: str = WATERMARK, window: int = 3600, slide: int = 1800, limit: int = 5) -> DataFrame:
    """``window_start, window_end, src_ip, user, failures``: each window of ``window`` seconds, every ``slide`` seconds, with more than ``limit`` failures.

    The window is a multiple of the slide. Times without zone are taken in the session's.
    """
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    windows = F.window(F.window_time("slot"), f"{window} seconds", f"{slide} seconds").alias("window")
    found = slot_counts(lines, slide, watermark).groupBy(windows, "src_ip", "user").agg(F.sum("failures").alias("failures"))
    return found.filter(F.col("failures") > limit).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "src_ip", "user", "failures")
