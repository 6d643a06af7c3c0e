"""Small side inputs: example banks, pattern dictionaries, tagged token files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import normalize_text

BANK_SCHEMA = "ID bigint, Asset string, Log string"


def example_bank(spark: SparkSession, path: str) -> DataFrame:
    """Known examples with their normalised text; a missing file gives an empty bank."""
    try:
        rows = spark.read.schema(BANK_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException:
        rows = spark.createDataFrame([], BANK_SCHEMA)
    return rows.withColumn("normalized_log", normalize_text(F.col("Log")))


def pattern_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``category, ord, pattern`` from a JSON object of category -> list of patterns."""
    rows = spark.read.option("multiLine", True).json(path)
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("patterns")) for c in rows.columns])
    return rows.select(F.inline(entries)).select("category", F.posexplode("patterns").alias("ord", "pattern"))


def patterns_by_category(patterns: DataFrame) -> dict[str, list[str]]:
    """The pattern table as a dictionary for building expressions.

    Patterns are settings typed by people; they become part of the query plan, so
    the table is read on the driver.
    """
    out: dict[str, list[str]] = {}
    for row in patterns.orderBy("category", "ord").toLocalIterator():
        out.setdefault(row["category"], []).append(row["pattern"])
    return out


def tagged_sentences(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``source, sentence, pos, token, tag`` from ``token TAG`` files; a blank line ends a sentence."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("sentence"), "value"
    )
    lines = blocks.select("source", "sentence", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    lines = lines.filter(F.trim("line") != "")
    token = F.regexp_extract("line", r"^(\S+)\s+(\S+)\s*$", 1)
    tag = F.regexp_extract("line", r"^(\S+)\s+(\S+)\s*$", 2)
    return lines.select("source", "sentence", "pos", token.alias("token"), tag.alias("tag"))
