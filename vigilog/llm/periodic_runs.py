"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period q, of at least LEAST words and EXPONENT periods,
that no neighbouring word extends. The texts of a batch are searched together:

1. Suffix array. Prefix doubling sorts the suffixes of all texts by their first 1, 2, 4, ... words; a suffix
   that shares its beginning with no other one of its text is left alone from then on. The ranks of every
   length are kept: equal ranks are equal blocks, and a block's suffixes are an interval of the array.
2. Dyadic blocks. For every length b = 4, 8, 16, ... the blocks that begin at multiples of b / 2 ask for their next
   occurrence: the least place after their own in their interval of the suffix array, which is a range
   successor query on a wavelet tree over the array.
3. Progressions. The occurrences of a block that begin in the b words after it are an arithmetic progression; its first
   step is the candidate period. A run of period q with b / 2 < q <= b (or q <= b for b = 4) is at least 4 q
   long, so a block of length b begins in it that is found again q words later, and not earlier, as
   that would give the run a smaller period.
4. Extension. A candidate's stretch of period q is extended to both sides by comparing blocks of falling length by their ranks.

All steps are array operations over a batch of at most WORDS words, or one longer text; nothing is shuffled.
A batch takes about 100 bytes for every word, and 4 more for each doubling.

Defined cases: a null text has no words, a text without words no runs; rows are judged one by one, so repeated
rows and ids, null ids and empty tables need nothing special; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import byte_texts

LEAST = 6
EXPONENT = 4
#: Words searched together.
WORDS = 1 << 18
SHORTEST = 4
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = f"doc_id bigint, n_words bigint, runs {RUN_TYPE}, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


# ---------------------------------------------------------------- suffix array and its wavelet tree

def _heads(keys: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array begins."""
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return head


def _first_slots(head: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return slots[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]


def suffix_ranks(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... words, and the places of the suffixes whose SHORTEST words are repeated, sorted.

    A rank is the first slot of the block's suffixes. Texts never share a rank, nor does a block that
    the end of its text cuts short.
    """
    n = len(words)
    keys = doc * (np.int64(words.max(initial=0)) + 1) + words
    sorted_places = np.argsort(keys, kind="stable")
    head, slots = _heads(keys[sorted_places]), np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sorted_places] = _first_slots(head, slots)
    levels, length, live = [rank.astype(np.int32)], 1, slots[:0]
    while len(slots):
        slots = slots[~(head & np.append(head[1:], True))]
        if length == SHORTEST:
            live = slots
        if not len(slots):
            break
        places = sorted_places[slots]
        after = places + length
        following = np.where(after < ends[places], rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[places] * (n + 1) + following
        order = np.argsort(keys, kind="stable")
        places, head = places[order], _heads(keys[order])
        sorted_places[slots] = places
        rank[places] = _first_slots(head, slots)
        levels.append(rank.astype(np.int32))
        length *= 2
    return levels, sorted_places[live]


class WaveletTree:
    """Counts and order statistics of any interval of an array, in a step for each bit of its values."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(int(values.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def smaller(self, begin: np.ndarray, end: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller."""
        beyond = than >> (self.levels[0][0] + 1) > 0  # of more bits than any value
        count = np.where(beyond, end - begin, 0)
        end = np.where(beyond, begin, end)
        for bit, zeros in self.levels:
            one = (than >> bit & 1).astype(bool)
            b, e = zeros[begin], zeros[end]
            count += np.where(one, e - b, 0)
            begin, end = np.where(one, zeros[-1] + begin - b, b), np.where(one, zeros[-1] + end - e, e)
        return count

    def nth(self, begin: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value that has ``n`` smaller ones in its interval."""
        value = np.zeros(len(begin), np.int64)
        for bit, zeros in self.levels:
            b, e = zeros[begin], zeros[end]
            one = n >= e - b
            n = n - np.where(one, e - b, 0)
            value |= one.astype(np.int64) << bit
            begin, end = np.where(one, zeros[-1] + begin - b, b), np.where(one, zeros[-1] + end - e, e)
        return value

    def successors(self, begin: np.ndarray, end: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a value greater than ``after``, and the least one of those that do."""
        count = self.smaller(begin, end, after + 1)
        found = np.flatnonzero(count < end - begin)
        return found, self.nth(begin[found], end[found], count[found])


# ---------------------------------------------------------------- runs

def candidates(levels: list[np.ndarray], live: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): blocks and the distance of their next occurrence."""
    tree = WaveletTree(live)
    places, periods = [live[:0]], [live[:0]]
    for k in range(SHORTEST.bit_length() - 1, len(levels)):
        length, ranks = 1 << k, levels[k][live]
        block = live[((live - starts[live]) % (length // 2) == 0) & (live + length <= ends[live])]
        begin, end = np.searchsorted(ranks, levels[k][block]), np.searchsorted(ranks, levels[k][block], side="right")
        repeated = end - begin > 1
        block, begin, end = block[repeated], begin[repeated], end[repeated]
        found, following = tree.successors(begin, end, block)
        step = following - block[found]
        near = (step <= length) & ((step > length // 2) | (length == SHORTEST))
        places.append(block[found][near])
        periods.append(step[near])
    return np.concatenate(places), np.concatenate(periods)


def extended(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch with the period that holds the place."""
    first, last = starts[place], ends[place]
    right, left = np.zeros_like(place), np.zeros_like(place)
    for k in range(len(levels) - 1, -1, -1):
        ranks, length = levels[k], 1 << k
        at = place + right
        inside = at + period + length <= last
        right += (inside & (ranks[np.where(inside, at, 0)] == ranks[np.where(inside, at + period, 0)])) * np.int64(length)
        at = place - left - length
        inside = at >= first
        left += (inside & (ranks[np.where(inside, at, 0)] == ranks[np.where(inside, at + period, 0)])) * np.int64(length)
    return place - left, place + period + right


def find_runs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all runs of some texts, in places of the texts set end to end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    words = np.fromiter(map(Numbers().__getitem__, itertools.chain.from_iterable(texts)), np.int64, n)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts, ends = edges[doc], edges[doc + 1]
    levels, live = suffix_ranks(words, doc, ends)
    place, period = candidates(levels, live, starts, ends)
    begin, end = extended(levels, place, period, starts, ends)
    long_enough = end - begin >= np.maximum(LEAST, EXPONENT * period)
    found = np.unique(np.stack([begin[long_enough], period[long_enough], end[long_enough]]), axis=1)
    return found[0], found[2], found[1]


def _rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    begin, end, period = find_runs(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.searchsorted(edges, begin, side="right") - 1
    change = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(begin - edges[doc]), pa.array(end - begin), pa.array(period)], names=["start", "length", "period"])
    for i in set(doc.tolist()):
        texts[i] = list(itertools.compress(texts[i], kept[edges[i]:edges[i + 1]].tolist()))
    collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), runs).cast(_RUNS), collapsed],
        names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of ``documents(doc_id, text)``, a row for each row.

    ``runs`` has ``start, length, period`` in words, by start and period; ``collapsed`` is the text's words joined
    by blanks without those that a run repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, text in zip(part.column("doc_id").to_pylist(), byte_texts(part.column("text"))):
                    split = text.split()
                    if texts and held + len(split) > words:
                        yield _rows(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(doc)
                    texts.append(split)
                    held += len(split)
        if texts:
            yield _rows(ids, texts)

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, RESULT)


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, exactly compared, the first of equals; null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


# ---------------------------------------------------------------- the registered query's input and columns

def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: with h = crc32(doc_id as text) and g = floor(h / 10), every text with h % 10 = 0 repeats, from word
    a = g % n on, its next p = 1 + floor((n - a) / (3 + g % 8)) words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = split.withColumn("a", F.when(n > 0, F.pmod("g", n)).cast("int")).withColumn("n", n)
    placed = placed.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    a, p, left = F.col("a"), F.col("p"), F.col("n") - F.col("a")
    copies = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(copies, F.lit(1), left)), " ")
    return placed.select("doc_id", F.when(a.isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_report(documents: DataFrame) -> DataFrame:
    """The digest of every text's runs and of its collapsed words."""
    found = periodic_runs(documents).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
