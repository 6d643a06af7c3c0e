"""Token tables, vocabularies, encoded and padded sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vigilog import fixed_values as fixed
from vigilog.functions.tokens import SPANS_TYPE, TAGGED_TYPE, bio_tags, entity_spans, last_span_per_type, tokenize
from vigilog.operators import dictionary
from vigilog.operators.ranking import numbered_in_ranges
from vigilog.session import scratch_path

PADDING, UNKNOWN, FIRST_WORD = 0, 1, 2
HEAD_WORDS = 50_000
HEAD_WORD_CHARS = 64
PLACE_BITS = 31
NEAR_BITS = 21


def token_rows(lines: DataFrame) -> DataFrame:
    """``line_id, pos, token`` of every line."""
    return lines.select("line_id", F.posexplode(tokenize(F.col("line"))).alias("pos", "token"))


def tagged_lines(lines: DataFrame, patterns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``line_id, tagged``: the weakly labelled corpus; lines without tokens are left out."""
    tagged = bio_tags(F.col("line"), tuple(patterns or fixed.TAG_PATTERNS))
    return _with_tokens(lines).select("line_id", tagged.alias("tagged"))


def _with_tokens(lines: DataFrame) -> DataFrame:
    """Lines that hold a token: anything but white space is one. A filter on tokens would make them twice."""
    return lines.filter(F.col("line").rlike(f"[^{fixed.WHITESPACE_CLASS}]"))


def once(column: str, empty: str) -> Column:
    """A list for ``explode`` or ``inline``. Of a bare column Spark tests the size first, and for that runs the Python function behind it twice."""
    return F.coalesce(F.col(column), F.expr(empty))


def token_tags(tagged: DataFrame) -> DataFrame:
    """``line_id, pos, token, tag``."""
    rows = tagged.select("line_id", F.inline(once("tagged", f"CAST(array() AS {TAGGED_TYPE})")))
    return rows.select("line_id", "pos", "token", "tag")


def span_rows(tagged: DataFrame) -> DataFrame:
    """``line_id, ord, type, value`` of the tagged entities. Spans are a column first, so that Spark makes them in the pass that tags."""
    spans = tagged.select("line_id", entity_spans(F.col("tagged")).alias("spans"))
    return spans.select("line_id", F.inline(once("spans", f"CAST(array() AS {SPANS_TYPE})")))


def last_spans(tagged: DataFrame) -> DataFrame:
    """``line_id, type, value``: of several spans of a type the last one."""
    last = tagged.select("line_id", last_span_per_type(entity_spans(F.col("tagged"))).alias("last"))
    return last.select("line_id", F.explode(once("last", "CAST(map() AS map<string,string>)")).alias("type", "value"))


def _place(line: Column, pos: Column) -> Column:
    """Line and place as one decimal; lines without an id come first."""
    line = F.coalesce(line.cast("decimal(19,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(19,0)"))
    return line * F.lit(1 << PLACE_BITS).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def _counts(tokens: DataFrame) -> DataFrame:
    """``word, occurrences, first_seen``, the last a value that orders tokens by line and place.

    Of whole-number ids it is a number, whose minimum Spark keeps in a hash table, a row for each word; a minimum of structs
    has all tokens of a task sorted first. Ids and places that fit together in 63 bits are compared so, all others as decimals.
    """
    words, number = tokens.groupBy(F.lower("token").alias("word")), F.count(F.lit(1)).alias("occurrences")
    if not isinstance(tokens.schema["line_id"].dataType, IntegralType):
        return words.agg(number, F.min(F.struct("line_id", "pos")).alias("first_seen"))
    line, pos = F.col("line_id").cast("bigint"), F.col("pos")
    fits = line.between(0, (1 << (63 - NEAR_BITS)) - 1) & (pos < 1 << NEAR_BITS)
    near = F.when(fits, F.shiftleft(line, NEAR_BITS).bitwiseOR(pos.cast("bigint")))
    found = words.agg(number, F.min(near).alias("_near"), F.min(F.when(near.isNull(), _place(line, pos))).alias("_far"))
    first = F.when(F.col("_near").isNotNull(), _place(F.shiftright("_near", NEAR_BITS), F.col("_near").bitwiseAND((1 << NEAR_BITS) - 1)))
    return found.select("word", "occurrences", F.least(first, "_far").alias("first_seen"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``word, idx, occurrences``: lower-cased words by falling count, then first appearance.

    0 and 1 are kept for padding and unknown words. The counted words are sorted in ranges, written once, and numbered
    by the sizes of the ranges: a shuffle for the counts and one for the order.
    """
    placed = numbered_in_ranges(_counts(tokens), [F.desc("occurrences"), "first_seen", "word"], "_place", "vocabulary")
    return placed.select("word", (F.col("_place") + (FIRST_WORD - 1)).cast("bigint").alias("idx"), "occurrences")


def tag_index(tagged: DataFrame) -> DataFrame:
    """``tag, idx`` of the tags present, alphabetical from 1; 0 is kept for padding.

    The tags come from the pattern list, at most two per pattern and ``O``, so the
    collected set is tiny.
    """
    tags = tagged.select(F.explode(F.array_distinct(F.col("tagged.tag"))).alias("tag"))
    found = tags.agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return found.select(F.posexplode("tags").alias("pos", "tag")).select("tag", (F.col("pos") + 1).cast("bigint").alias("idx"))


def tag_numbers(patterns: Sequence[tuple[str, str]] | None = None) -> dict[str, int]:
    """All tags a pattern list can give, numbered alphabetically from 1."""
    kinds = [tag for tag, _ in (patterns or fixed.TAG_PATTERNS)]
    tags = sorted({"O", *[f"B-{k}" for k in kinds], *[f"I-{k}" for k in kinds]})
    return {tag: i for i, tag in enumerate(tags, 1)}


def tag_to_number(tag: Column, numbers: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.try_element_at(table, tag)


def number_to_tag(number: Column, numbers: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for tag, i in numbers.items() for x in (i, tag)])
    return F.try_element_at(table, number.cast("int"))


def encode_tokens(tokens: DataFrame, words: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """Adds ``idx`` to the tokens; words outside the vocabulary get the unknown index.

    The frequent words, at most ``head_words`` short ones, are broadcast: that is a
    few megabytes at most. Rare words are joined by a shuffle; a token that was
    already found takes a key of its own line there, so no key is hot.
    """
    frequent = (F.col("idx") < FIRST_WORD + head_words) & (F.length("word") <= HEAD_WORD_CHARS)
    near = words.filter(frequent).select(F.col("word").alias("_word"), F.col("idx").alias("_near"))
    rare = words.filter(~frequent).select(F.col("word").alias("_key"), F.col("idx").alias("_far"))
    lowered = tokens.withColumn("_word", F.lower("token")).join(F.broadcast(near), "_word", "left")
    own = F.concat(F.lit(" "), F.col("line_id").cast("string"))
    keyed = lowered.withColumn("_key", F.when(F.col("_near").isNull(), F.col("_word")).otherwise(own))
    found = keyed.join(rare, "_key", "left")
    return found.withColumn("idx", F.coalesce("_near", "_far", F.lit(UNKNOWN)).cast("bigint")).drop("_word", "_key", "_near", "_far")


def encoded_lines(encoded: DataFrame, keys: Sequence[str] = ("line_id",)) -> DataFrame:
    """The keys with ``ids, length``: word indices of each line in token order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "idx")))
    return encoded.groupBy(*keys).agg(F.transform(ordered, lambda s: s["idx"]).alias("ids")).withColumn("length", F.size("ids"))


def encode_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """The lines that hold a token, with ``ids, length`` in place of ``line``.

    ``words`` is written as a block dictionary, which the distinct words of every chunk of lines are looked up in; no token is
    shuffled. Of a word that comes twice the smallest index counts. Lines with the same id stay lines of their own.
    """
    path = dictionary.write_dictionary(words, scratch_path(lines.sparkSession, "dictionary"))
    line = F.col("line")
    # Of ASCII letters, which have a byte each, lower case leaves all tokens where they are.
    tokens = F.when(F.octet_length(line) == F.length(line), tokenize(F.lower(line))).otherwise(F.transform(tokenize(line), lambda t: F.lower(t)))
    return dictionary.encode(_with_tokens(lines).withColumn("line", tokens), path, "line", UNKNOWN)


def with_batches(lines: DataFrame, batch_size: int = 16) -> DataFrame:
    """The lines that hold a token with ``batch``: runs of ``batch_size`` lines in id order."""
    return in_batches(_with_tokens(lines), batch_size)


def in_batches(lines: DataFrame, batch_size: int = 16) -> DataFrame:
    """All lines with ``batch``: runs of ``batch_size`` lines in id order. The lines are written once."""
    placed = numbered_in_ranges(lines, ["line_id"], "_place", "batches")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / batch_size)).drop("_place")


def padded(encoded: DataFrame) -> DataFrame:
    """``ids`` filled up to the longest line of their ``batch``, which is a few rows."""
    longest = F.max("length").over(Window.partitionBy("batch"))
    fill = F.array_repeat(F.lit(PADDING).cast("bigint"), longest - F.col("length"))
    return encoded.select("line_id", "batch", "length", F.concat("ids", fill).alias("ids"))
