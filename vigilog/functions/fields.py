"""Fields, categories and labels read out of a log line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.text import unicode_regex


def first_match(line: Column, pattern: str, group: int) -> Column:
    """First match of a pattern, or null."""
    return F.nullif(F.regexp_extract(line, unicode_regex(pattern), group), F.lit(""))


def log_fields(line: Column) -> list[Column]:
    """timestamp, ip, user, status and method as whole matches."""
    return [first_match(line, p, 0).alias(name) for name, p in fixed.LINE_FIELDS.items()]


def search_field(line: Column, name: str) -> Column:
    """user, src_ip or action as the searches use them."""
    return first_match(line, fixed.SEARCH_FIELDS[name], 1).alias(name)


def search_fields(line: Column) -> list[Column]:
    return [search_field(line, name) for name in fixed.SEARCH_FIELDS]


def transform_fields(line: Column) -> list[Column]:
    """severity, session_id and normalized_user."""
    return [first_match(line, p, 1).alias(name) for name, p in fixed.TRANSFORM_FIELDS.items()]


def first_rule(line: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first rule whose regex is found in the line."""
    out = F
    for pattern, value in rules:
        out = out.when(line.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(default))


def first_containing(line: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Value of the first rule one of whose words occurs in the lower-cased line."""
    low = F.lower(line)
    out = F
    for value, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def log_level(line: Column) -> Column:
    return first_rule(line, fixed.LOG_LEVELS, fixed.DEFAULT_LOG_LEVEL)


def event_category(line: Column) -> Column:
    return first_rule(line, fixed.EVENT_CATEGORIES, fixed.DEFAULT_EVENT_CATEGORY)


def ssh_label(text: Column) -> Column:
    return first_rule(text, fixed.SSH_RULES, fixed.RULE_DEFAULT)


def linux_label(text: Column) -> Column:
    return first_rule(text, fixed.LINUX_RULES, fixed.RULE_DEFAULT)


def asset_type(line: Column) -> Column:
    return first_containing(line, fixed.ASSET_TYPES, fixed.DEFAULT_ASSET_TYPE)


def log_format(line: Column) -> Column:
    found = first_containing(line, fixed.LOG_FORMATS, fixed.DEFAULT_LOG_FORMAT)
    return F.when(line.isNull(), F.lit(fixed.EMPTY_LOG_FORMAT)).otherwise(found)


def clock_hours(line: Column) -> Column:
    """Hours of every clock time in the line."""
    found = F.regexp_extract_all(line, F.lit(fixed.CLOCK_HOUR), F.lit(1))
    return F.transform(found, lambda h: h.cast("int"))


def line_time(line: Column, year: int | None = None) -> Column:
    """Time stamp of a line, trying the known formats in order.

    The syslog form carries no year: it is read only when ``year`` is given.
    """
    parsed = []
    for pattern, time_format in fixed.LOG_TIMES:
        found = F.regexp_extract(line, pattern, 0)
        if time_format.startswith("MMM d"):
            if year is None:
                continue
            found = F.when(found != "", F.concat(F.lit(f"{year} "), F.regexp_replace(found, " +", " ")))
            time_format = "yyyy " + time_format
        elif time_format.endswith("SSSSSS'Z'"):
            digits = F.regexp_extract(found, r"\.(\d+)Z$", 1)
            found = F.concat(F.substring(found, 1, 20), F.rpad(digits, 6, "0"), F.lit("Z"))
        elif time_format == "yyyy-MM-dd HH:mm:ss":
            found = F.translate(found, "T", " ")
        parsed.append(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit(time_format)))
    return F.coalesce(*parsed)
