"""Text normalising and display expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed


def unicode_regex(pattern: str) -> str:
    """The pattern with word, digit and space classes covering all scripts."""
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{fixed.WHITESPACE_CLASS}]+", " "))


def split_words(text: Column, squeezed: bool = False) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    words = F.split(text if squeezed else collapse_spaces(text), " ", -1)
    return F.filter(words, lambda w: w != "")


def is_filled(text: Column) -> Column:
    return text.isNotNull() & (F.length(strip(text)) > 0)


def replace_each(text: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(unicode_regex(pattern)), F.lit(replacement))
    return text


def normalize_text(text: Column) -> Column:
    """Line without times, addresses, ports, numbers and brackets, in lower case.

    Capitals that follow a letter are split off before lower-casing.
    """
    removals = [(p, "") for p in fixed.TIMESTAMP_REMOVALS + fixed.ADDRESS_REMOVALS]
    steps = [*removals, (fixed.BRACKETS_AND_QUOTES, " "), (fixed.CAPITAL_AFTER_LETTER, " ")]
    bare = replace_each(F.coalesce(text.cast("string"), F.lit("")), steps)
    return collapse_spaces(F.lower(bare))


def preprocess_text(text: Column, options: Mapping | None = None) -> Column:
    """Lower-cased text without digits or punctuation, with login terms unified."""
    options = fixed.SCORING_OPTIONS if options is None else options
    patterns = [tuple(p) for p in options["normalization_patterns"]]
    out = replace_each(F.lower(F.coalesce(text.cast("string"), F.lit(""))), patterns)
    out = F.translate(out, fixed.ASCII_PUNCTUATION, "")
    # Without digits none of the time or address patterns can match.
    if (r"\d+", "") not in patterns:
        out = replace_each(out, [(p, "") for p in fixed.TIMESTAMP_REMOVALS + fixed.ADDRESS_REMOVALS])
    return collapse_spaces(replace_each(out, options["term_normalizations"].items()))


def preview(text: Column, limit: int = fixed.PREVIEW_CHARS) -> Column:
    """Text cut to ``limit`` characters with dots, for display only."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def matches_search(text: Column, pattern: str) -> Column:
    """Case-insensitive regex search; missing text does not match."""
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def row_text(columns: Iterable[str | Column]) -> Column:
    """All cells of a row in one blank-separated text; missing cells read ``nan``."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in cells])


def label_slug(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("_"))


def format_prediction(prediction: Column) -> Column:
    """``label (0.000)`` for a struct of label and confidence, ``N/A`` when missing."""
    return F.when(prediction.isNull(), F.lit("N/A")).otherwise(
        F.format_string(
            "%s (%.3f)",
            F.coalesce(prediction["label"], F.lit("Unknown")),
            F.coalesce(prediction["confidence"], F.lit(0.0)),
        )
    )


def record_id(log_text: Column, timestamp: Column) -> Column:
    """Twelve hex characters from the text and its time stamp."""
    both = F.concat(F.coalesce(log_text, F.lit("")), F.coalesce(timestamp.cast("string"), F.lit("")))
    return F.substring(F.md5(both.cast("binary")), 1, 12)


def longest_first(words: Column) -> Column:
    """Words ordered by falling length, equal lengths alphabetically."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("order"), w.alias("word")))
    return F.transform(F.array_sort(keyed), lambda s: s["word"])


def highlight(text: Column, keywords: Column, before: str, after: str) -> Column:
    """Text with every keyword wrapped, in one pass, longer keywords winning.

    One alternation is matched once over the original text, so inserted markup
    is never searched again.
    """
    quoted = F.transform(
        longest_first(F.filter(keywords, lambda w: w != "")),
        lambda w: F.regexp_replace(w, r"([\\^$.|?*+(){}\[\]])", r"\\$1"),
    )
    pattern = F.concat(F.lit("("), F.array_join(quoted, "|"), F.lit(")"))
    wrapped = F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))
    return F.when(F.size(quoted) > 0, wrapped).otherwise(text)
