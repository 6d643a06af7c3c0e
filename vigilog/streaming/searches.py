"""The scheduled searches and the feedback store as Structured Streaming jobs.

A scheduled search looks back over a fixed time and runs periodically; as a stream
that is a window over event time. Appended to files, a window's result appears once the watermark has
passed its end, so the newest windows stay open until later lines arrive, and lines
older than the watermark are dropped. Written as versions, every version holds all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.functions.fields import search_field
from vigilog.operators.reports import dictionary_labels
from vigilog.operators.searches import failed_login_counts, with_event_category

WATERMARK = "1 hour"


def event_time(lines: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Lines with ``ts`` as a zoned time stamp (streams need one) and a watermark on it."""
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def alert_stream(lines: DataFrame, watermark: str = WATERMARK, window: str = "1 hour", slide: str = "30 minutes", limit: int = 5) -> DataFrame:
    """Failed-login alerts: windows where one address and user failed too often."""
    counts = failed_login_counts(event_time(lines, watermark), F.window("ts", window, slide))
    return counts.filter(F.col("failures") > limit).select(*_bounds(), "src_ip", "user", "failures")


def hourly_stream(lines: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Events per hour and category."""
    return _category_counts(event_time(lines, watermark), F.window("ts", "1 hour"))


def daily_summary_stream(lines: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Events per category for the 24 hours up to 9 o'clock."""
    return _category_counts(event_time(lines, watermark), F.window("ts", "1 day", startTime="9 hours"))


def _category_counts(lines: DataFrame, window: Column) -> DataFrame:
    counted = with_event_category(lines).groupBy(window.alias("window"), "event_category").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*_bounds(), "event_category", "events")


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def classified_stream(lines: DataFrame) -> DataFrame:
    """Every line with its category, dictionary label and search fields; keeps no state."""
    found = dictionary_labels(with_event_category(lines))
    return found.withColumns({name: search_field(F.col("line"), name) for name in ("user", "src_ip", "action")})


def feedback_stream(records: DataFrame, watermark: str | None = None) -> DataFrame:
    """Feedback records for the store; with a watermark on ``ts`` repeated records are dropped.

    The short id is no proof that records are equal, so the text counts as well.
    """
    if watermark is None:
        return records
    return event_time(records, watermark).dropDuplicatesWithinWatermark(["record_id", "log_text"])


def parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """A stream of parquet files; ``path`` may hold wildcards."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start_to_files(stream: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Append a stream to files; restarts continue exactly once from the checkpoint folder."""
    return (
        stream.writeStream.outputMode("append")
        .format(file_format)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def start_to_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the full result of every micro-batch as a new version below ``path``.

    A retried batch overwrites only its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def last_version(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest of the versions that ``start_to_versions`` wrote."""
    versions = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).parquet(path)
    newest = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")
