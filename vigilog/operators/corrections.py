"""Analyst corrections: load, store, filter, count and mark as used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import format_prediction, matches_search, preview, record_id

PREDICTION = "struct<label:string,confidence:double>"
SCHEMA = (
    f"log_text string, original_prediction {PREDICTION}, user_correction {PREDICTION}, timestamp string, "
    "record_id string, used_for_training boolean, training_timestamp string"
)


def with_defaults(corrections: DataFrame) -> DataFrame:
    """Records without an id or a used flag get them."""
    return corrections.withColumns(
        {
            "record_id": F.coalesce("record_id", record_id(F.col("log_text"), F.col("timestamp"))),
            "used_for_training": F.coalesce("used_for_training", F.lit(False)),
        }
    )


def load_corrections(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stored records: JSON lines, or with ``multi_line`` one JSON array per file."""
    return with_defaults(spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path))


def feedback_records(feedback: DataFrame, timestamp: Column) -> DataFrame:
    """Records to store from ``log_text, original_prediction, user_correction``."""
    stamp = timestamp.cast("string")
    return feedback.select(
        "log_text",
        "original_prediction",
        "user_correction",
        stamp.alias("timestamp"),
        record_id(F.col("log_text"), stamp).alias("record_id"),
        F.lit(False).alias("used_for_training"),
    )


def append_feedback(records: DataFrame, path: str) -> None:
    """Add records to the store; each append writes its own files, nothing is rewritten."""
    records.write.mode("append").json(path)


def write_snapshot(corrections: DataFrame, path: str) -> None:
    """A full new version in a folder that must not exist yet."""
    corrections.write.mode("errorifexists").json(path)


def display_table(corrections: DataFrame) -> DataFrame:
    return corrections.select(
        F.coalesce("record_id", F.lit("N/A")).alias("record_id"),
        preview(F.col("log_text")).alias("log_preview"),
        F.col("log_text").alias("full_log_text"),
        format_prediction(F.col("original_prediction")).alias("original_prediction"),
        format_prediction(F.col("user_correction")).alias("user_correction"),
        F.coalesce("timestamp", F.lit("N/A")).alias("timestamp"),
        F.coalesce("used_for_training", F.lit(False)).alias("used_for_training"),
    )


def used(corrections: DataFrame, flag: bool = True) -> DataFrame:
    marked = F.coalesce("used_for_training", F.lit(False))
    return corrections.filter(marked if flag else ~marked)


def unused(corrections: DataFrame) -> DataFrame:
    return used(corrections, False)


def search(corrections: DataFrame, pattern: str) -> DataFrame:
    return corrections.filter(matches_search(F.col("log_text"), pattern))


def filtered_counts(corrections: DataFrame, condition: Column) -> DataFrame:
    """How many records a filter shows, of how many."""
    return corrections.agg(F.count_if(condition).alias("shown"), F.count(F.lit(1)).alias("total"))


def usage_stats(corrections: DataFrame) -> DataFrame:
    flag = F.coalesce("used_for_training", F.lit(False))
    counts = corrections.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("used"))
    rate = F.col("used") / F.greatest("total", F.lit(1)) * 100
    return counts.select("total", "used", (F.col("total") - F.col("used")).alias("unused"), rate.alias("usage_rate"))


def correction_types(corrections: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("user_correction.label"), F.lit("Unknown"))
    return corrections.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("corrections"))


def _keys(ids: DataFrame) -> list[str]:
    """What tells records apart: the id, which is short, and the text where the chosen records carry it."""
    return [c for c in ("record_id", "log_text") if c in ids.columns]


def mark_used(corrections: DataFrame, ids: DataFrame, timestamp: str, session: str | None = None) -> DataFrame:
    """The corrections in ``ids(record_id[, log_text])`` marked as used."""
    keys = _keys(ids)
    chosen = ids.select(*keys).distinct().withColumn("_chosen", F.lit(True))
    hit = F.coalesce("_chosen", F.lit(False))
    changes = {
        "used_for_training": hit | F.coalesce("used_for_training", F.lit(False)),
        "training_timestamp": F.when(hit, F.lit(timestamp)).otherwise(F.col("training_timestamp")),
    }
    if session is not None:
        changes["dataset_generation_session"] = F.when(hit, F.lit(session))
    return corrections.join(chosen, keys, "left").withColumns(changes).drop("_chosen")


def selected(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    return corrections.join(ids.select(*_keys(ids)), _keys(ids), "left_semi")


def remaining(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    return corrections.join(ids.select(*_keys(ids)), _keys(ids), "left_anti")
