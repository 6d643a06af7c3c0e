"""Pattern labels: dictionary patterns, security patterns and attack patterns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REGEX_SIGNS = re.compile(r"[\\^$.|?*+()\[\]]")


def escape_braces(pattern: str) -> str:
    """Dictionary patterns hold literal braces, which the regex engine would read as counts."""
    return pattern.replace("{", r"\{").replace("}", r"\}")


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def dictionary_hit(line: Column, pattern: str) -> Column:
    """Whether a dictionary pattern is found; one without regex signs is a plain substring test."""
    if REGEX_SIGNS.search(pattern):
        return line.rlike(escape_braces(pattern))
    return line.contains(pattern)


def dictionary_hits(line: Column, patterns: Sequence[str]) -> Column:
    """Ordinals (from 0) of the dictionary patterns found in the line."""
    flags = [F.when(dictionary_hit(line, p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*flags))


def dictionary_label(hits: Mapping[str, Column]) -> Column:
    """Category with hits; failures win over successes."""
    out = F
    for category in sorted(hits, key=lambda c: not c.endswith("failure")):
        out = out.when(F.size(hits[category]) > 0, F.lit(category))
    return out.otherwise(F.lit("none"))


def attack_hits(line: Column, patterns: Sequence[tuple[str, str]], threshold: float) -> Column:
    """Array of (category, pattern, matches, confidence) for the patterns found in the line."""
    hits = []
    for category, pattern in patterns:
        found = F.regexp_extract_all(line, F.lit("(?iU)" + pattern), F.lit(0))
        hits.append(F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"), found.alias("matches")))
    scored = F.transform(
        F.array(*hits),
        lambda h: F.struct(
            h["category"].alias("category"),
            h["pattern"].alias("pattern"),
            h["matches"].alias("matches"),
            F.least(F.lit(1.0), F.size(h["matches"]) * F.lit(0.3) + F.lit(0.4)).alias("confidence"),
        ),
    )
    return F.filter(scored, lambda h: (F.size(h["matches"]) > 0) & (h["confidence"] >= threshold))
