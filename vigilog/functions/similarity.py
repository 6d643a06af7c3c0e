"""Similarity of two texts: shared words, TF-IDF, string ratio."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.text import normalize_text, split_words
from vigilog.functions.tokens import bigrams

LONG_WORD = rf"[{fixed.WORD_CLASS}]{{2,}}"


def token_breakdown(pairs: DataFrame, line: str, example: str) -> DataFrame:
    """Adds the shared and one-sided normalised words and the shared phrases, as arrays.

    The word sets are worked out once, in a projection of their own.
    """
    texts = pairs.withColumns({"_line": normalize_text(F.col(line)), "_example": normalize_text(F.col(example))})
    sets = texts.withColumns(
        {
            "_mine": F.array_distinct(split_words(F.col("_line"), squeezed=True)),
            "_theirs": F.array_distinct(split_words(F.col("_example"), squeezed=True)),
            "_words": split_words(F.col(line)),
        }
    )
    phrases = F.filter(bigrams(F.col("_words")), lambda b: F.contains(F.col(example), b))
    found = sets.withColumns(
        {
            "common_tokens": F.array_sort(F.array_intersect("_mine", "_theirs")),
            "unique_to_log": F.array_sort(F.array_except("_mine", "_theirs")),
            "unique_to_example": F.array_sort(F.array_except("_theirs", "_mine")),
            "_phrases": phrases,
        }
    )
    joined = F.concat("common_tokens", "_phrases")
    return found.withColumn("important_phrases", joined).drop("_line", "_example", "_mine", "_theirs", "_words", "_phrases")


def _numbers(n: Column) -> Column:
    """1 to n; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def tfidf_similarity(pairs: DataFrame, first: str, second: str, out: str = "lexical") -> DataFrame:
    """Cosine of the two texts' TF-IDF vectors, fitted on just those two texts.

    A shared term weighs 1, a one-sided term ``ln(3/2) + 1``. All of it is worked out within the row: the words
    of both sides are sorted together, so that equal ones, and the two counts of a shared term, are neighbours. Nothing
    is shuffled, and long texts cost no more than the sort.
    """

    def words(column: str, side: int) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(LONG_WORD), F.lit(0))
        return F.transform(found, lambda w: F.struct(w.alias("term"), F.lit(side).alias("side")))

    w, at, groups = F.col("_w"), F.col("_at"), F.col("_groups")
    sorted_words = pairs.withColumn("_w", F.array_sort(F.concat(words(first, 1), words(second, 2))))
    # Where a run of equal words of one side begins.
    starts = F.filter(_numbers(F.size(w)), lambda i: F.when(i == 1, True).otherwise(F.element_at(w, i) != F.try_element_at(w, i - 1)))
    placed = sorted_words.withColumn("_at", starts)
    runs = F.transform(
        _numbers(F.size(at)),
        lambda k: F.struct(
            F.element_at(w, F.element_at(at, k)).alias("word"),
            (F.coalesce(F.try_element_at(at, k + 1), F.size(w) + 1) - F.element_at(at, k)).cast("double").alias("n"),
        ),
    )
    counted = placed.withColumn("_groups", runs)

    def same(k: Column, other: Column) -> Column:
        """The neighbouring run, if it holds the same term."""
        there = F.when(other > 0, F.try_element_at(groups, other))
        return F.when(there["word"]["term"] == F.element_at(groups, k)["word"]["term"], there["n"])

    alone = F.log(F.lit(1.5)) + 1.0
    weights = F.transform(
        _numbers(F.size(groups)),
        lambda k: F.struct(
            F.element_at(groups, k)["word"]["side"].alias("side"),
            (F.element_at(groups, k)["n"] * F.when(same(k, k - 1).isNotNull() | same(k, k + 1).isNotNull(), 1.0).otherwise(alone)).alias("w"),
            (F.element_at(groups, k)["n"] * F.coalesce(same(k, k + 1), F.lit(0.0))).alias("dot"),
        ),
    )
    weighed = counted.withColumn("_weights", weights)
    total = lambda value: F.aggregate("_weights", F.lit(0.0), lambda t, g: t + value(g))
    norm = lambda side: total(lambda g: F.when(g["side"] == side, g["w"] * g["w"]).otherwise(0.0))
    summed = weighed.withColumns({"_dot": total(lambda g: g["dot"]), "_n1": norm(1), "_n2": norm(2)})
    cosine = F.when((F.col("_n1") > 0) & (F.col("_n2") > 0), F.col("_dot") / F.sqrt(F.col("_n1") * F.col("_n2"))).otherwise(F.lit(0.0))
    return summed.withColumn(out, cosine).drop("_w", "_at", "_groups", "_weights", "_dot", "_n1", "_n2")


#: Characters after which a comparison with a threshold looks whether it can still be met.
LOOK_AFTER = 256
#: Pairs of texts that a Python pass takes at once; Spark's own batches have 10,000 rows.
PAIR_ROWS = 256


def _common_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end behind it; some longest common subsequence holds both."""
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:  # slices compare at machine speed
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    begin, left = low, n - low
    low, high = 0, left
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle:len(a) - low] == b[len(b) - middle:len(b) - low] else (low, middle - 1)
    return begin, low


def _places(text: str, wanted: set[str]) -> dict[str, int]:
    """For every wanted character of the text the bits of its places, 64 to a machine word; made a byte at a time, so in linear time."""
    bits: dict[str, bytearray] = {}
    size = len(text) // 8 + 1
    for ch in wanted.intersection(text):
        own = bits[ch] = bytearray(size)
        at = text.find(ch)
        while at >= 0:
            own[at >> 3] |= 1 << (at & 7)
            at = text.find(ch, at + 1)
    return {ch: int.from_bytes(own, "little") for ch, own in bits.items()}


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence; where it is under ``least``, any smaller length may come instead.

    One pass over the shorter text, each step a few operations on a bit for every character of the longer one.
    """
    if len(a) < len(b):
        a, b = b, a
    begin, end = _common_ends(a, b)
    done, a, b = begin + end, a[begin:len(a) - end], b[begin:len(b) - end]
    if not b or done + sum((Counter(a) & Counter(b)).values()) < least:
        return done
    places, full = _places(a, set(b)), (1 << len(a)) - 1
    row = full
    for i, ch in enumerate(b):
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        if least and i % LOOK_AFTER == LOOK_AFTER - 1 and done + len(a) - row.bit_count() + len(b) - 1 - i < least:
            break
    return done + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * common_subsequence(a, b) / total if total else 1.0


def ratio_at_least(a: str, b: str, least: float) -> float | None:
    """The ratio where it is ``least`` or more, else None; hopeless pairs are left early."""
    total = len(a) + len(b)
    if not total:
        return 1.0 if least <= 1 else None
    needed = math.ceil(least * total / 2 - 1e-9)
    if min(len(a), len(b)) < needed:
        return None
    found = 2.0 * common_subsequence(a, b, needed) / total
    return found if found >= least else None


def text_pairs(left: pa.Array, right: pa.Array) -> Iterator[tuple]:
    """The rows of two text columns, of which PAIR_ROWS at a time become Python objects."""
    for at in range(0, len(left), PAIR_ROWS):
        yield from zip(left.slice(at, PAIR_ROWS).to_pylist(), right.slice(at, PAIR_ROWS).to_pylist())


def string_ratio(a: Column, b: Column) -> Column:
    """``2 * LCS / (len1 + len2)``, 1 for two empty texts.

    No built-in gives the common subsequence (``levenshtein`` counts a substitution
    once, not twice), so this is an Arrow function.
    """

    @F.arrow_udf("double")
    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = text_pairs(left, right)
        return pa.array([None if x is None or y is None else ratio(x, y) for x, y in pairs], pa.float64())

    return ratios(a, b)


def string_ratio_at_least(a: Column, b: Column, least: float) -> Column:
    """``string_ratio`` where it is ``least`` or more, else null.

    A pair is dropped by its lengths, by the characters it has in common, or as soon as the rest cannot make up for what is missing.
    """

    @F.arrow_udf("double")
    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = text_pairs(left, right)
        return pa.array([None if x is None or y is None else ratio_at_least(x, y, least) for x, y in pairs], pa.float64())

    return ratios(a, b)


def combined_similarity(semantic: Column, lexical: Column, string: Column) -> Column:
    return semantic * 0.5 + lexical * 0.3 + string * 0.2
