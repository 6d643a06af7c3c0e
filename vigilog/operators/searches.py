"""The security searches: alerts, summaries, activity and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.fields import event_category, log_level, search_field, search_fields, transform_fields

FAILURE = "authentication_failure"
SUCCESS = "authentication_success"


def with_event_category(lines: DataFrame) -> DataFrame:
    return lines.withColumn("event_category", event_category(F.col("line")))


def calculated_fields(lines: DataFrame, app_name: str = fixed.APP_NAME) -> DataFrame:
    """Every extracted and calculated search field of a line."""
    line = F.col("line")
    return lines.select(
        "line_id",
        *search_fields(line),
        *transform_fields(line),
        log_level(line).alias("log_level"),
        event_category(line).alias("event_category"),
        F.lit(app_name).alias("app_name"),
    )


def category_search(lines: DataFrame, category: str | None) -> DataFrame:
    """Lines of one event category, or all lines."""
    found = with_event_category(lines)
    return found if category is None else found.filter(F.col("event_category") == category)


def failed_login_counts(lines: DataFrame, window: Column) -> DataFrame:
    """Failed logins per time window, address and user.

    Only failures are kept before the fields are extracted; the counts are summed
    in each task before the shuffle, so one noisy address moves a few rows.
    """
    failed = category_search(lines, FAILURE)
    keyed = failed.select(
        window.alias("window"), search_field(F.col("line"), "src_ip"), search_field(F.col("line"), "user")
    ).filter(F.col("src_ip").isNotNull() & F.col("user").isNotNull())
    return keyed.groupBy("window", "src_ip", "user").agg(F.count(F.lit(1)).alias("failures"))


def failed_login_alert(lines: DataFrame, window: str = "1 hour", slide: str | None = None, limit: int = 5) -> DataFrame:
    """Windows in which one address and user failed more than ``limit`` times."""
    counts = failed_login_counts(lines, F.window("ts", window, slide))
    return counts.filter(F.col("failures") > limit).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "src_ip", "user", "failures"
    )


def count_by(df: DataFrame, field: str) -> DataFrame:
    """Rows per value, most frequent first; rows without a value do not count."""
    counts = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), field)


def security_summary(lines: DataFrame) -> DataFrame:
    return count_by(with_event_category(lines), "event_category")


def hourly_activity(lines: DataFrame) -> DataFrame:
    """Events per hour and category, in time order; empty hours are left out."""
    counted = with_event_category(lines).groupBy(_hour(), "event_category").agg(F.count(F.lit(1)).alias("events"))
    return _by_hour(counted, "event_category")


def activity_by_hour(lines: DataFrame) -> DataFrame:
    return _by_hour(lines.groupBy(_hour()).agg(F.count(F.lit(1)).alias("events")))


def _hour() -> Column:
    """Hour windows keep the type of ``ts``, so times without zone stay independent of the session's."""
    return F.window("ts", "1 hour").alias("window")


def _by_hour(counted: DataFrame, *columns: str) -> DataFrame:
    return counted.select(F.col("window.start").alias("hour"), *columns, "events").orderBy("hour", *columns)


def top_users(lines: DataFrame, n: int = 10) -> DataFrame:
    return count_by(lines.select(search_field(F.col("line"), "user")), "user").limit(n)


def failed_sources(lines: DataFrame, n: int = 20) -> DataFrame:
    failed = category_search(lines, FAILURE)
    return count_by(failed.select(search_field(F.col("line"), "src_ip")), "src_ip").limit(n)


def register_search_views(lines: DataFrame, prefix: str = "logs") -> None:
    """Temporary views for the base, failed-login and successful-login searches."""
    category_search(lines, None).createOrReplaceTempView(f"{prefix}_base_search")
    category_search(lines, FAILURE).createOrReplaceTempView(f"{prefix}_failed_logins")
    category_search(lines, SUCCESS).createOrReplaceTempView(f"{prefix}_successful_logins")
