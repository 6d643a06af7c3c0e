"""Line statistics, score summaries, histograms, entity and attack reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.entities import entity_array
from vigilog.functions.fields import clock_hours, log_format
from vigilog.functions.patterns import any_of, attack_hits, dictionary_hits, dictionary_label
from vigilog.functions.text import unicode_regex
from vigilog.operators.ranking import first_rows_per

PATTERNS_PER_PASS = 200


# ---------------------------------------------------------------- lines

def line_statistics(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Line count and lengths; an empty table gives zeros."""
    n = F.length("line")
    return lines.groupBy(*by).agg(
        F.count("line").alias("total_lines"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_length"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_characters"),
    )


def source_formats(lines: DataFrame, source: str = "source", id_col: str = "line_id") -> DataFrame:
    """Suspected format of every source, judged by its first line."""
    first = first_rows_per(lines.select(source, id_col, "line"), [source], [id_col], 1)
    return first.select(source, log_format(F.col("line")).alias("suspected_format"))


def format_report(lines: DataFrame, source: str = "source", id_col: str = "line_id") -> DataFrame:
    """Per source: line count, mean length, and what its first ten lines show.

    Times count when one pattern matches more than half of the sample; one
    address in the sample is enough.
    """
    totals = lines.groupBy(source).agg(
        F.count("line").alias("total_lines"), F.avg(F.length("line")).alias("avg_line_length")
    )
    sample = first_rows_per(
        lines.select(source, id_col, "line"), [source], [id_col], fixed.FORMAT_SAMPLE_LINES, out="_rank"
    )
    line = F.col("line")
    half = F.count(F.lit(1)) * 0.5
    timed = F.lit(False)
    for pattern in fixed.FORMAT_TIMESTAMPS:
        timed = timed | (F.count_if(line.rlike(unicode_regex(pattern))) > half)
    judged = sample.groupBy(source).agg(
        timed.alias("has_timestamps"),
        (F.count_if(line.rlike(unicode_regex(fixed.FORMAT_ADDRESS))) > 0).alias("has_ip_addresses"),
        F.max(F.when(F.col("_rank") == 1, log_format(line))).alias("suspected_format"),
    )
    return totals.join(judged, source).withColumn("valid", F.col("total_lines") > 0)


# ---------------------------------------------------------------- scores

def score_metrics(scores: DataFrame, column: str, threshold: float = fixed.SCORE_THRESHOLD) -> DataFrame:
    score = F.col(column)
    return scores.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(score >= threshold).alias("above_threshold"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
    )


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    """Mean, extremes, sample deviation and the three score bands, in one pass."""
    score = F.col(column)
    return scores.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        F.min(score).alias("min_score"),
        F.stddev_samp(score).alias("std_score"),
        F.count_if(score_band(score) == "High").alias("high"),
        F.count_if(score_band(score) == "Medium").alias("medium"),
        F.count_if(score_band(score) == "Low").alias("low"),
    )


def analysis_summary(scores: DataFrame, column: str, total_log_lines: Column | None = None) -> DataFrame:
    """State of an analysis: line and result counts, and score extremes when there are results."""
    found = scores.agg(
        F.count(F.lit(1)).alias("analysis_entries"),
        F.avg(column).alias("mean_confidence"),
        F.max(column).alias("max_confidence"),
        F.min(column).alias("min_confidence"),
    )
    status = F.when(F.col("analysis_entries") > 0, "has_results").otherwise("no_results")
    lines = F.col("analysis_entries") if total_log_lines is None else total_log_lines
    return found.select(status.alias("status"), lines.alias("total_log_lines"), "*")


def score_band(score: Column) -> Column:
    return (
        F.when(score >= fixed.HIGH_SCORE, "High")
        .when(score >= fixed.SCORE_THRESHOLD, "Medium")
        .when(score.isNotNull(), "Low")
    )


def at_least(scores: DataFrame, column: str, threshold: float = fixed.SCORE_THRESHOLD) -> DataFrame:
    return scores.filter(F.col(column) >= threshold)


def top_scores(scores: DataFrame, column: str, id_col: str, n: int = fixed.TOP_RESULTS) -> DataFrame:
    return scores.orderBy(F.desc(column), id_col).limit(n)


def score_histogram(scores: DataFrame, column: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins, each closed on the left, the last on both sides.

    The extremes come in as one scalar subquery; the counts are summed per task
    first. Empty bins are kept.
    """
    extremes = _extremes(scores, column)
    low, high = F.col("_range.low"), F.col("_range.high")
    # All values equal: the range is opened by a half on either side.
    start, stop = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)
    found = scores.filter(F.col(column).isNotNull()).select(column, extremes)
    place = F.least(F.floor((F.col(column) - start) / (stop - start) * bins), F.lit(bins - 1))
    counts = found.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    edges = _bin_rows(scores, bins, 0).select("bin", extremes).select(
        "bin",
        (start + (stop - start) / bins * F.col("bin")).alias("lower"),
        (start + (stop - start) / bins * (F.col("bin") + 1)).alias("upper"),
    )
    return _with_counts(edges, counts)


def equal_width_bins(values: DataFrame, column: str, bins: int = fixed.ATTACK_BINS) -> DataFrame:
    """Counts in equal-width bins closed on the right, the lowest edge widened by 0.1 %.

    Values are counted per distinct value first, and the extremes come from those
    counts. The bin of a value is found by comparing it with the bin edges.
    """
    distinct = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    extremes = _extremes(distinct, column)
    low, high = F.col("_range.low"), F.col("_range.high")
    flat = low == high
    # All values equal: the range is opened by 0.1 % of the value on either side.
    pad = F.when(low == 0, 0.001).otherwise(F.abs(low) * 0.001)
    start, stop = F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
    step = (stop - start) / bins
    place = F.lit(1)
    for i in range(1, bins):
        place = place + (F.col(column) > start + step * i).cast("int")
    placed = distinct.select(column, "_n", extremes)
    counts = placed.groupBy(place.alias("bin")).agg(F.sum("_n").alias("events"))
    first_edge = F.when(flat, start).otherwise(start - (stop - start) * 0.001)
    edges = _bin_rows(values, bins, 1).select("bin", extremes).select(
        "bin",
        F.when(F.col("bin") == 1, first_edge).otherwise(start + step * (F.col("bin") - 1)).alias("lower"),
        F.when(F.col("bin") == bins, stop).otherwise(start + step * F.col("bin")).alias("upper"),
    )
    return _with_counts(edges, counts)


def _extremes(df: DataFrame, column: str) -> Column:
    """``_range``: struct of the smallest and largest value, as a scalar subquery.

    The one-element ``explode`` keeps the optimizer from copying the subquery into
    every expression that reads the range.
    """
    both = F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    return F.explode(F.array(df.agg(both).scalar())).alias("_range")


def _bin_rows(df: DataFrame, bins: int, first: int) -> DataFrame:
    return df.sparkSession.range(first, first + bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))


def _with_counts(edges: DataFrame, counts: DataFrame) -> DataFrame:
    return edges.join(counts, "bin", "left").withColumn("events", F.coalesce("events", F.lit(0))).orderBy("bin")


# ---------------------------------------------------------------- counts

def value_counts(df: DataFrame, *columns: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, equal counts by name."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), *columns)
    return counts if limit is None else counts.limit(limit)


def distinct_counts(df: DataFrame, column: str) -> DataFrame:
    """Which group sizes occur."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).select("rows").distinct()


# ---------------------------------------------------------------- entities

def entity_rows(lines: DataFrame, known_hosts: Sequence[str] = ()) -> DataFrame:
    """``line_id, type, ord, entity``: one row per entity found."""
    found = entity_array(F.col("line"), known_hosts)
    return lines.select("line_id", F.inline(found))


def unique_entities(entities: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct entities per type; types without any are left out."""
    count = F.approx_count_distinct("entity") if approximate else F.countDistinct("entity")
    return entities.groupBy("type").agg(count.alias("unique_entities"))


def top_entities(entities: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent entities per type; equal counts in order of first appearance."""
    seen = F.struct("line_id", "ord")
    counts = entities.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("events"), F.min(seen).alias("first_seen"))
    return first_rows_per(counts, ["type"], [F.desc("events"), "first_seen"], n, out="rank").drop("first_seen")


# ---------------------------------------------------------------- timeline

def events_by_hour(lines: DataFrame) -> DataFrame:
    """Clock times found per hour of day, 24 rows."""
    hours = lines.select(F.explode(clock_hours(F.col("line"))).alias("hour"))
    counts = hours.groupBy("hour").agg(F.count(F.lit(1)).alias("events"))
    day = lines.sparkSession.range(0, 24, numPartitions=1).select(F.col("id").cast("int").alias("hour"))
    return day.join(counts, "hour", "left").withColumn("events", F.coalesce("events", F.lit(0))).orderBy("hour")


def peak_hour(lines: DataFrame) -> DataFrame:
    """The busiest hour, the smaller one of equals."""
    hours = lines.select(F.explode(clock_hours(F.col("line"))).alias("hour"))
    counts = hours.groupBy("hour").agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), "hour").limit(1)


# ---------------------------------------------------------------- patterns

def dictionary_labels(lines: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Adds which dictionary patterns hit each line, per category, and the label."""
    patterns = fixed.EVENT_PATTERNS if patterns is None else patterns
    found = lines.withColumns({f"{c}_hits": dictionary_hits(F.col("line"), p) for c, p in patterns.items()})
    return found.withColumn("label", dictionary_label({c: F.col(f"{c}_hits") for c in patterns}))


def security_pattern_matches(lines: DataFrame, patterns: Sequence[tuple[str, str, float, list[str]]] | None = None) -> DataFrame:
    """Per security pattern: matching lines and the first of them, in one pass."""
    patterns = fixed.SECURITY_PATTERNS if patterns is None else patterns
    aggregates = []
    for i, (_, pattern, _, _) in enumerate(patterns):
        hit = F.col("line").rlike("(?iU)" + pattern)
        aggregates += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.col("line_id"))).alias(f"first{i}")]
    one = lines.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(pattern).alias("pattern"),
            F.lit(confidence).alias("confidence"),
            F.lit(",".join(fields)).alias("fields"),
            F.col(f"n{i}").alias("lines"),
            F.col(f"first{i}").alias("first_line_id"),
        )
        for i, (name, pattern, confidence, fields) in enumerate(patterns)
    ]
    return one.select(F.inline(F.array(*rows)))


def detect_attacks(
    lines: DataFrame,
    patterns: Mapping[str, Sequence[str]] | None = None,
    categories: Sequence[str] | None = None,
    threshold: float = fixed.ATTACK_THRESHOLD,
    per_pass: int = PATTERNS_PER_PASS,
) -> DataFrame:
    """``line_id, category, pattern, matches, confidence``: one row per line and pattern.

    The patterns are literals in one projection, behind one cheap alternation that
    drops the lines without any hit; no line x pattern join is built. A list of more than
    ``per_pass`` patterns is worked through in several such passes, with the same rows.
    """
    patterns = fixed.ATTACK_PATTERNS if patterns is None else patterns
    wanted = [(c, p) for c in (patterns if categories is None else categories) if c in patterns for p in patterns[c]]
    result = None
    for at in range(0, max(len(wanted), 1), per_pass):
        part = wanted[at:at + per_pass]
        line = F.col("line")
        if part:
            some = lines.filter(line.rlike("(?iU)" + any_of([p for _, p in part])))
            hits = some.select("line_id", F.inline(attack_hits(line, part, threshold)))
        else:
            nothing = F.array().cast("array<struct<category:string,pattern:string,matches:array<string>,confidence:double>>")
            hits = lines.select("line_id", F.inline(nothing))
        result = hits if result is None else result.unionByName(hits)
    return result


def attack_counts(hits: DataFrame) -> DataFrame:
    """Hits per category and the total; the total is summed from the category counts."""
    counts = hits.groupBy("category").agg(F.count(F.lit(1)).alias("hits"))
    total = counts.agg(F.lit("Total").alias("category"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return counts.unionByName(total)
