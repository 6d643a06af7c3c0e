"""Tokens, their offsets and their BIO tags."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed

TOKEN_PATTERN = rf"[{fixed.WORD_CLASS}]+|[^{fixed.WORD_CLASS}{fixed.WHITESPACE_CLASS}]"
SPAN_TYPE = "array<struct<pos:int,start:int,end:int,token:string>>"
SPANS_TYPE = "array<struct<ord:int,type:string,value:string>>"
TAGGED_TYPE = "array<struct<pos:int,start:int,end:int,token:string,tag:string>>"

_PYTHON_TOKEN = re.compile(r"\w+|[^\w\s]")


def tokenize(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Adjacent word pairs, blank-joined."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def tokens_in_spans(tokens: Column, spans: Column) -> Column:
    """For each (start, end) span the tokens it fully contains, within the row."""
    return F.transform(
        spans,
        lambda s: F.filter(tokens, lambda t: (t["start"] >= s["start"]) & (t["end"] <= s["end"])),
    )


def tag_spans(text: str, patterns: Sequence[tuple[str, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(tag, start, end) of every pattern match; a capture group narrows the span."""
    spans = []
    for tag, pattern in patterns:
        group = 1 if pattern.groups else 0
        spans.extend((tag, *m.span(group)) for m in pattern.finditer(text))
    return spans


def compile_tags(patterns: Sequence[tuple[str, str]]) -> list[tuple[str, re.Pattern]]:
    return [(tag, re.compile(p, re.IGNORECASE)) for tag, p in patterns]


def tags_of(text: str, starts: list[int], ends: list[int], patterns: Sequence[tuple[str, re.Pattern]]) -> list[str]:
    """A tag per token; later patterns overwrite earlier ones."""
    tags = ["O"] * len(starts)
    for tag, start, end in tag_spans(text, patterns):
        first = bisect.bisect_left(starts, start)
        last = bisect.bisect_right(ends, end)
        if first < last:
            tags[first:last] = ["B-" + tag] + ["I-" + tag] * (last - first - 1)
    return tags


def _token_lists(texts: pa.Array, patterns: list[tuple[str, re.Pattern]], with_tags: bool) -> pa.Array:
    offsets, pos, start, end, token, tag = [0], [], [], [], [], []
    for text in texts.to_pylist():
        if text:
            found = _PYTHON_TOKEN.findall(text)
            starts, at = [], 0
            for t in found:  # between tokens there is white space only, so the next place that reads alike is the token's
                at = text.index(t, at)
                starts.append(at)
                at += len(t)
            ends = list(map(int.__add__, starts, map(len, found)))
            pos.extend(range(len(found)))
            start.extend(starts)
            end.extend(ends)
            token.extend(found)
            if with_tags:
                tag.extend(tags_of(text, starts, ends, patterns))
        offsets.append(len(pos))
    columns = {
        "pos": pa.array(pos, pa.int32()),
        "start": pa.array(start, pa.int32()),
        "end": pa.array(end, pa.int32()),
        "token": pa.array(token, pa.string()),
    }
    if with_tags:
        columns["tag"] = pa.array(tag, pa.string())
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns))
    )


def token_spans(text: Column) -> Column:
    """Tokens with their character offsets.

    Spark has no function for match offsets, so this is an Arrow function.
    """

    @F.arrow_udf(SPAN_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        return _token_lists(texts, [], False)

    return spans(text)


def bio_tags(text: Column, patterns: Sequence[tuple[str, str]] = tuple(fixed.TAG_PATTERNS)) -> Column:
    """Tokens with offsets and BIO tags for the given (tag, pattern) list."""

    @F.arrow_udf(TAGGED_TYPE)
    def tags(texts: pa.Array) -> pa.Array:
        return _token_lists(texts, compile_tags(patterns), True)

    return tags(text)


def _list_parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The offsets and the elements of a list column; a null list has no elements."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]), pc.list_flatten(lists)


def _span_lists(tagged: pa.Array) -> pa.Array:
    """The spans of every list of tagged tokens, all of a batch at once."""
    offsets, elements = _list_parts(tagged)
    tags = pc.struct_field(elements, "tag").dictionary_encode()
    names = [t or "" for t in tags.dictionary.to_pylist()]
    kinds = {}
    number = [kinds.setdefault(t[2:], len(kinds)) if t[:2] in ("B-", "I-") else -1 for t in names] + [-1]
    begins, inside = (np.array([t.startswith(x) for t in names] + [False]) for x in ("B-", "I-"))
    known = tags.indices.is_valid().to_numpy(zero_copy_only=False)
    code = np.where(known, tags.indices.fill_null(0).to_numpy(zero_copy_only=False), len(names))
    number = np.array(number)[code]
    places = np.arange(len(code))
    begin = begins[code]
    last = np.maximum.accumulate(np.where(begin, places, -1))  # the begin before each tag, of any row
    goes_on = ~known | (inside[code] & (last >= 0) & (number == number[last]))
    ending = ~goes_on
    ending[offsets[:-1][offsets[:-1] < len(code)]] = True  # no span goes on in the next row
    stops = np.append(np.flatnonzero(ending), len(code))
    starts = np.flatnonzero(begin)
    ends = stops[np.searchsorted(stops, starts, "right")]

    held = np.zeros(len(code) + 1, np.int64)
    np.add.at(held, starts, 1)
    np.add.at(held, ends, -1)
    words = pc.struct_field(elements, "token")
    kept = (np.cumsum(held[:-1]) > 0) & words.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    pieces = pa.ListArray.from_arrays(pa.array(np.append(before[starts], before[-1]), pa.int32()), words.filter(pa.array(kept)))
    rows = np.searchsorted(starts, offsets)
    order = np.arange(len(starts)) - np.repeat(rows[:-1], np.diff(rows))
    columns = {
        "ord": pa.array(order, pa.int32()),
        "type": pa.array([t[2:] for t in names] + [""], pa.string()).take(pa.array(code[starts])),
        "value": pc.binary_join(pieces, " "),
    }
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def entity_spans(tagged: Column) -> Column:
    """Array of (ord, type, value): each B- tag with the I- tags of its type that follow.

    A span ends where a tag is no I- of its type; its tokens are joined by blanks. An Arrow function over whole batches: behind
    ``bio_tags`` Spark runs both in one pass, and only the spans leave it.
    """

    @F.arrow_udf(SPANS_TYPE)
    def spans(lists: pa.Array) -> pa.Array:
        return _span_lists(lists)

    return spans(tagged)


def _last_lists(spans: pa.Array) -> pa.Array:
    offsets, elements = _list_parts(spans)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kinds = pc.struct_field(elements, "type")
    codes = kinds.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    mixed = rows * (codes.max(initial=0) + 2) + codes + 1
    first = np.sort(np.unique(mixed, return_index=True)[1])
    last = len(mixed) - 1 - np.unique(mixed[::-1], return_index=True)[1]
    place = dict(zip(mixed[last].tolist(), last.tolist()))
    taken = pa.array([place[x] for x in mixed[first].tolist()], pa.int64())
    columns = {"key": kinds.take(taken), "value": pc.struct_field(elements, "value").take(taken)}
    sizes = pa.array(np.searchsorted(first, offsets), pa.int32())
    return pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays(list(columns.values()), list(columns)), mask=spans.is_null())


def last_span_per_type(spans: Column) -> Column:
    """Map type -> value; of several spans of a type the last one stays."""

    @F.arrow_udf("array<struct<key:string,value:string>>")
    def last(lists: pa.Array) -> pa.Array:
        return _last_lists(lists)

    return F.map_from_entries(last(spans))
