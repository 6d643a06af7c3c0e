"""Language-model scores of a hierarchical Pitman-Yor model.

Every word of the training texts is a context with a restaurant of its own, whose customers are the words that follow it. What
these restaurants share is a parent over words, which knows a context by its class: the FREQUENT most frequent
tokens are classes of their own, all others fall into RARE classes by a hash. The parent's probability of a token behind another one is
that of its class behind the other's class, times that of the token in its class:

* each class is a context restaurant whose customers are the tables of the words' restaurants, by the classes of context and
  word; all class restaurants share one parent, whose customers are their tables, and the
  parent's base is uniform;
* each rare class is a restaurant of its tokens, whose customers are again the tables of the words' restaurants, with a uniform base
  over the types seen in the class and an unknown one.

Seating is sampled by Gibbs sweeps. In a sweep all customers of a dish leave their restaurant
and are seated again one by one, by the Chinese restaurant process, given the tables of the other dishes
and the parent's probabilities as the last sweep left them; dishes and restaurants are seated in parallel. Every customer
is a draw of its own. Random numbers are hashes of dish, sweep and customer, so a task that runs again seats alike.
The predictive probabilities of the sweeps after BURN_IN are averaged. The words' restaurants start with a table for each word;
their sweeps are given the parent of that start, and the parent that scores is sampled from the tables of their last sweep.

The pairs of neighbours in each block are dealt out to buckets, whose number grows with the training texts: by their context, so that a
restaurant is seated in one task, and those of the FREQUENT contexts by their word, with their numbers of tables
summed up after every sweep; a word has at most FREQUENT such pairs. Pairs are told apart by 64-bit hashes of their words' hashes.
Within a bucket they are ordered by context and word, so that places rise, and packed with each word's hash once.

All counts are over all training texts. Texts are encoded in blocks of at most BLOCK tokens; for
each block and each of its distinct words one row is counted, and resolved by a join, so that no shuffle has a row for every token and
no task holds the vocabulary or all pairs. Only tables bounded by (FREQUENT + RARE)^2 reach the driver.

Tokens are words, lower-cased from A to Z, and one end for each text; the end is also what comes before a
text. Words are told apart by 64-bit hashes. Defined cases: a null text is empty and has its end as the only token;
rows without id are never learned from; repeated rows count as often as they come; without training texts
all probabilities are the bases'; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import WordHash, dropped, held_out, small, mixed, stored

FOLDS = 10
FREQUENT = 1000
RARE = 128
BLOCK = 4_000_000
SWEEPS, BURN_IN = 4, 2
#: Training tokens of each further bucket of pairs, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 2_000_000, 64
#: Discount and strength of the restaurants of words, of classes, of their parent and of the rare classes.
WORDS, CONTEXT, PARENT, TOKENS = (0.75, 1.0), (0.5, 2.0), (0.5, 2.0), (0.75, 1.0)
#: Rows that are packed at once.
PACKED = 1 << 18
END = b"\n"  # no word
ENCODED = "block bigint, ids array<bigint>, sizes array<int>, held array<boolean>, words binary, vocabulary binary, trained binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


# ---------------------------------------------------------------- seating

def uniform(keys: np.ndarray, sweep: int, *customers: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the arguments, a row for each customer."""
    seeds = [(sweep * 0x9E3779B97F4A7C15 + customer * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF for customer in customers]
    return (mixed(np.add.outer(np.array(seeds, np.uint64), keys.view(np.uint64))) >> np.uint64(11)).astype(float) * 2.0**-53


def seat(counts: np.ndarray, opening: np.ndarray, discount: float, keys: np.ndarray, sweep: int, growth: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of each dish when its customers sit down one after another.

    ``opening``: the weight of a new table, that is (strength + discount x tables of other dishes) x the parent's probability; it
    grows by ``growth`` with each table of the dish. The chance of a new table falls until one is opened, so those who might open
    one are found by geometric leaps at the present chance, and open it with what is left of theirs: a draw for every customer.
    """
    tables = (counts > 0).astype(np.int64)
    at = np.flatnonzero(counts > 1)
    # Of the dishes that still have customers to seat; as floats, which hold such numbers exactly.
    opening, growth, keys, total = (np.broadcast_to(x, counts.shape)[at] for x in (opening, growth, keys, counts.astype(float)))
    own, seated, step = np.ones(len(at)), np.ones(len(at)), 0
    while len(at):
        leaps, draws = uniform(keys, sweep, step, step + 1)
        weight = opening + growth * own
        rest = weight - discount * own
        chance = weight / (seated + rest)
        leap = np.floor(np.log1p(-leaps) / np.log1p(-chance))
        seated += np.minimum(leap, total - seated)
        own += (draws < weight / (seated + rest) / chance) & (seated < total)
        seated += 1
        step += 2
        more = seated < total
        if not more.all():
            tables[at[~more]] = own[~more]
            at, opening, growth, keys, total, own, seated = (x[more] for x in (at, opening, growth, keys, total, own, seated))
    return tables


# ---------------------------------------------------------------- blocks

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one text after the other, and the number of words of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # space at an end of a text leaves an empty word
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    return words.filter(full), np.bincount(row[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


#: How numbers are packed: bytes by their place in the number, steps from one number to the next, each distinct one once and
#: places among these, or as they are, which is best where one stands many times in a row.
PLANES, STEPS, DISTINCT, RUNS = range(4)


def pack(x: np.ndarray, way: int = PLANES) -> bytes:
    """The way, then the numbers, compressed."""
    if way == DISTINCT:
        return pack_distinct(*np.unique(x, return_inverse=True))
    if way == STEPS:
        x = np.diff(x, prepend=x.dtype.type(0))  # may wrap, as the sum does
    x = np.ascontiguousarray(x)
    if way != RUNS:
        size, most = x.dtype.itemsize, int(x.view(f"u{x.dtype.itemsize}").max(initial=0))
        planes = np.zeros((size, len(x)), np.uint8)
        for i in range((most.bit_length() + 7) // 8):  # those above are empty
            planes[i] = x.view(np.uint8)[i::size]
        x = planes
    return bytes([way]) + zstandard.ZstdCompressor(level=1).compress(x.data if x.size else b"")


def pack_distinct(found: np.ndarray, at: np.ndarray) -> bytes:
    """The numbers ``found[at]``, of rising ``found``; what no place names is left out."""
    named = np.zeros(len(found), bool)
    named[at] = True
    at = (np.cumsum(named, dtype=np.int32) - np.int32(1))[at]
    head, rises = pack(found[named], STEPS), bool((at[1:] >= at[:-1]).all())
    return bytes([DISTINCT]) + len(head).to_bytes(4, "little") + head + pack(at, STEPS if rises else PLANES)


def unpack_distinct(x: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, rising, and the places among them."""
    end = 5 + int.from_bytes(x[1:5], "little")
    return unpack(x[5:end], kind), unpack(x[end:], np.int32)


def unpack(x: bytes, kind) -> np.ndarray:
    if x[0] == DISTINCT:
        found, at = unpack_distinct(x, kind)
        return found[at]
    way, x = x[0], x[1:]
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    if way == RUNS:
        return values.view(kind)
    size = np.dtype(kind).itemsize
    planes = values.reshape(size, -1)
    values = np.zeros(planes.shape[1], kind)
    for i, plane in enumerate(planes):
        if plane.any():
            values.view(np.uint8)[i::size] = plane
    return np.cumsum(values, dtype=kind) if way == STEPS else values


def encoded(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """ENCODED: blocks of whole texts as numbers, with each block's vocabulary and its counts in training texts."""

    def run(parts):
        number = TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
        each: list[tuple] = []  # ids, held, sizes, words

        def row(number):
            ids, held, sizes, words = zip(*each)
            held, sizes = np.concatenate(held), np.concatenate(sizes) + 1
            coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries().chunks  # none without words
            found = coded[0].dictionary.cast(pa.large_binary()).to_pylist() if coded else []
            tokens = np.ones(int(sizes.sum()), np.int32)
            tokens[np.cumsum(sizes) - 1] = 0  # the end is the first of the vocabulary
            tokens[tokens > 0] = 1 + np.concatenate([np.empty(0, np.int32), *(x.indices.to_numpy() for x in coded)])
            trained = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(found) + 1).astype(np.int64)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [END, *found]), np.uint64, len(found) + 1)
            values = (number, [i for part in ids for i in part], sizes.astype(np.int32), held, pack(tokens), hashes.tobytes(), pack(trained))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in ENCODED.split(", ")])

        total = 0
        for batch in parts:
            ids, held = (batch.column(c).to_pylist() for c in ("doc_id", "held"))
            words, sizes = split_words(batch.column("text"))
            starts, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < len(ids):
                tokens = total + np.cumsum(sizes[at:] + 1)
                to = min(len(ids), at + int(np.searchsorted(tokens, block)) + 1)  # a block ends with the text that fills it
                each.append((ids[at:to], np.array(held[at:to], bool), sizes[at:to], words.slice(starts[at], starts[to] - starts[at])))
                total, at = int(tokens[to - at - 1]), to
                if total >= block:
                    yield row(number)
                    number, total = number + 1, 0
                    each.clear()
        if each:
            yield row(number)

    chosen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", FOLDS).alias("held"), "text")
    return chosen.mapInArrow(small(run), ENCODED)


def placed_words(blocks: DataFrame) -> DataFrame:
    """``word, block, place, n``: a row for each block and distinct word, its number there and its count in training texts."""

    def run(parts):
        for batch in parts:
            for block, words, trained in zip(*(batch.column(c).to_pylist() for c in ("block", "vocabulary", "trained"))):
                words, trained = np.frombuffer(words, np.int64), unpack(trained, np.int64)
                for at in range(0, len(words), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    n = len(words[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[part]), pa.array(np.full(n, block, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int32)),
                         pa.array(trained[part])], names=["word", "block", "place", "n"])

    return blocks.select("block", "vocabulary", "trained").mapInArrow(run, "word bigint, block bigint, place int, n bigint")


# ---------------------------------------------------------------- classes

class Classes:
    """The class of a word: its place among the frequent ones, or one of the rare classes by its hash."""

    def __init__(self, frequent: list[int]):
        self.words = np.array(sorted(frequent), np.int64)

    def __len__(self) -> int:
        return len(self.words) + RARE

    def of(self, words: np.ndarray) -> np.ndarray:
        rare = len(self.words) + (mixed(words.view(np.uint64)) % np.uint64(RARE)).astype(np.int64)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, rare)


def _before(tokens: np.ndarray) -> np.ndarray:
    """What comes before each token of a block; its first token and those behind an end follow an end.

    Every block ends with the end of a text.
    """
    return np.concatenate([tokens[-1:], tokens[:-1]])


def context_sweeps(cells: DataFrame, size: int) -> np.ndarray:
    """The averaged probability of each class (column) behind each class (row)."""
    discount, strength = CONTEXT
    parent = np.full(size, 1.0 / size)
    mean = np.zeros((size, size))
    state = cells.groupBy("context").agg(F.collect_list(F.struct("dish", "n")).alias("cells"))  # at most ``size`` cells in a restaurant
    state = stored(state.withColumn("tables", F.size("cells").cast("bigint")), "restaurants")
    state = state.withColumn("opened", F.transform("cells", lambda c: F.lit(1).cast("bigint")))
    schema = "context int, cells array<struct<dish:int,n:bigint>>, tables bigint, opened array<bigint>"
    dishes = np.arange(size, dtype=np.uint64)
    for sweep in range(SWEEPS):

        def run(parts, parent=parent, sweep=sweep):
            for batch in parts:
                rows = []
                for context, found, tables, before in zip(batch["context"], batch["cells"], batch["tables"], batch["opened"]):
                    dish, n = (np.array([c[k] for c in found], np.int64) for k in ("dish", "n"))
                    opening = (strength + discount * (tables - np.asarray(before, np.int64))) * parent[dish]
                    opened = seat(n, opening, discount, (dish + context * size + (1 << 40)), sweep, discount * parent[dish])
                    rows.append((context, list(found), int(opened.sum()), opened.tolist()))
                yield pd.DataFrame(rows, columns=["context", "cells", "tables", "opened"])

        seated = stored(state.select("context", "cells", "tables", "opened").mapInPandas(run, schema), "seated")
        dropped(state)
        customers = np.zeros(size, np.int64)
        sums = seated.select(F.explode(F.arrays_zip(F.col("cells.dish").alias("dish"), "opened")).alias("c"))
        for dish, n in sums.groupBy("c.dish").agg(F.sum("c.opened")).collect():
            customers[dish] = n
        parent = _predictive(customers, _parent_tables(customers, parent, dishes, sweep), PARENT, np.full(size, 1.0 / size))
        if sweep >= BURN_IN:
            totals = np.zeros(size)
            tables = np.zeros(size)
            sample = np.zeros((size, size))
            for row in seated.toLocalIterator():
                dish, n = (np.array([c[k] for c in row["cells"]], np.int64) for k in ("dish", "n"))
                totals[row["context"]], tables[row["context"]] = n.sum(), row["tables"]
                sample[row["context"], dish] = n - discount * np.array(row["opened"])
            mean += (sample + (strength + discount * tables)[:, None] * parent) / (strength + totals)[:, None]
        state = seated
    dropped(state)
    return (mean / (SWEEPS - BURN_IN)).astype(np.float32)


def _parent_tables(customers: np.ndarray, parent: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    discount, strength = PARENT
    tables = np.minimum(customers, 1)
    for _ in range(2):  # the first round only finds how many tables there are
        tables = seat(customers, (strength + discount * (tables.sum() - tables)) / len(customers), discount, keys, sweep, discount / len(customers))
    return tables


def _predictive(customers: np.ndarray, tables: np.ndarray, kind: tuple[float, float], base: np.ndarray) -> np.ndarray:
    discount, strength = kind
    return (customers - discount * tables + (strength + discount * tables.sum()) * base) / (strength + customers.sum())


# ---------------------------------------------------------------- tokens of the rare classes

class RareRestaurants:
    """The restaurants of the rare classes, known by their numbers of customers and, for each sweep, of tables."""

    def __init__(self, classes: Classes):
        self.classes = classes
        self.customers = np.zeros(len(classes))
        self.tables: list[np.ndarray] = []  # at first every word seen has one table

    @property
    def base(self) -> np.ndarray:
        return 1.0 / (self.tables[0] + 1.0)

    def opened(self, words: np.ndarray, counts: np.ndarray, sweeps: int) -> Iterator[np.ndarray]:
        """The tables of each word after each of the first sweeps."""
        discount, strength = TOKENS
        kind = self.classes.of(words)
        own = (counts > 0).astype(np.int64)
        for sweep in range(sweeps):
            base = self.base[kind]
            own = seat(counts, (strength + discount * (self.tables[sweep][kind] - own)) * base, discount, words, sweep, discount * base)
            yield own

    def probability(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Averaged over the sweeps behind the burn-in; 1 for a frequent word."""
        discount, strength = TOKENS
        kind = self.classes.of(words)
        counts = np.where(kind < len(self.classes.words), 0, counts)
        total = np.zeros(len(words))
        for sweep, opened in enumerate(self.opened(words, counts, SWEEPS)):
            if sweep >= BURN_IN:
                shared = (strength + discount * self.tables[sweep + 1]) * self.base
                total += (counts - discount * opened + shared[kind]) / (strength + self.customers[kind])
        return np.where(kind < len(self.classes.words), 1.0, total / (SWEEPS - BURN_IN))


def rare_sweeps(counts: DataFrame, classes: Classes) -> RareRestaurants:
    """Tables of the rare classes in every sweep over ``counts(word, c)``."""
    rooms = RareRestaurants(classes)
    for sweep in range(-1, SWEEPS):

        def run(parts, sweep=sweep):
            customers, tables = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
            for batch in parts:
                words, n = batch.column("word").to_numpy(), batch.column("c").to_numpy()
                kind = classes.of(words)
                opened = (n > 0).astype(np.int64)
                for opened in rooms.opened(words, n, sweep + 1):
                    pass
                np.add.at(customers, kind, n)
                np.add.at(tables, kind, opened)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(classes), dtype=np.int32)), pa.array(customers), pa.array(tables)], names=["kind", "customers", "tables"])

        sums = counts.select("word", "c").mapInArrow(run, "kind int, customers bigint, tables bigint").groupBy("kind").agg(F.sum("customers"), F.sum("tables"))
        tables = np.zeros(len(classes))
        for kind, customers, n in sums.collect():
            rooms.customers[kind], tables[kind] = customers, n
        rooms.tables.append(tables)
    return rooms


# ---------------------------------------------------------------- restaurants of words

TALLIES = "cells binary, cell_tables binary, rare binary, rare_tables binary"
MERGED = "bucket int, contexts binary, words binary, n binary, blocks array<bigint>, places array<binary>, " + TALLIES
#: Of a bucket's pairs of frequent contexts that come twice or more; the tables of all pairs of these contexts by class, and of those that come once.
FREQUENT_PAIRS = "keys binary, parent binary, n binary, kind binary, opened binary, kinds binary, tables binary, others binary"
SEATED = "bucket int, own binary, share binary, " + TALLIES


def block_pairs(words: bytes, vocabulary: np.ndarray, classes: Classes, buckets: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs of a block by bucket, context and word: both in its vocabulary, buckets, and the pair of each token."""
    size = len(vocabulary)
    by_hash = np.argsort(vocabulary).astype(np.int32)
    rank = np.empty(size, np.int32)
    rank[by_hash] = np.arange(size)
    tokens = rank[unpack(words, np.int32)]
    wide, far = (max(1, (x - 1).bit_length()) for x in (size, len(tokens)))
    pairs = _before(tokens).astype(np.uint64)
    pairs <<= wide
    pairs |= tokens.view(np.uint32)
    del tokens
    if 2 * wide + far <= 64:  # sorting numbers that end with their places is several times faster than argsort
        pairs <<= far
        pairs |= np.arange(len(pairs), dtype=np.uint32)
        pairs.sort()
        order = (pairs & ((1 << far) - 1)).astype(np.uint32)
        pairs >>= far
    else:
        order = pairs.argsort()
        pairs = pairs[order]
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    del order
    pairs = pairs[first]
    context, word = by_hash[pairs >> wide], by_hash[pairs & ((1 << wide) - 1)]
    del pairs
    # Both for each word of the vocabulary, which are far fewer than the pairs.
    frequent = (classes.of(vocabulary) < len(classes.words))[context]
    bucket = (mixed(vocabulary.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[np.where(frequent, word, context)]
    order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")  # of 16 bits at most, this is a radix sort
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return context[order], word[order], bucket[order], place[of]


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + words.view(np.uint64))


def tallies(contexts: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], tables: np.ndarray, classes: Classes) -> tuple[bytes, ...]:
    """TALLIES: the tables by classes of context and word, and by rare word; contexts and words as distinct ones and places."""
    (found, word), kind = words, classes.of(words[0])
    cells, of = np.unique((classes.of(contexts[0]) * len(classes))[contexts[1]] + kind[word], return_inverse=True)
    sums = np.bincount(word, tables, minlength=len(found)).astype(np.int64)
    rare = (kind >= len(classes.words)) & (sums > 0)
    return pack(cells, STEPS), pack(np.bincount(of, tables, minlength=len(cells)).astype(np.int64)), pack(found[rare], STEPS), pack(sums[rare])


def gathered(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed distinct numbers of several parts as those of all, and the places one part after the other."""
    parts = [unpack_distinct(x, np.int64) for x in parts]
    found = np.unique(np.concatenate([f for f, _ in parts]))
    return found, np.concatenate([np.searchsorted(found, f)[at] for f, at in parts])


def merged_pairs(blocks: DataFrame, classes: Classes, buckets: int) -> DataFrame:
    """MERGED: a bucket's pairs in training texts, and twice the place among them of each pair that a block has there.

    A pair that no training text has gets 3 more than twice the place of one with its context, or 1 without any.
    """

    def deal(parts):
        for batch in parts:
            for block, sizes, held, words, vocabulary in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "held", "words", "vocabulary"))):
                vocabulary = np.frombuffer(vocabulary, np.int64)
                context, word, bucket, of = block_pairs(words, vocabulary, classes, buckets)
                n = np.bincount(of[np.repeat(~np.array(held, bool), sizes)], minlength=len(context))
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    values = (int(bucket[i]), block, pack(vocabulary[context[i:j]], DISTINCT), pack(vocabulary[word[i:j]], DISTINCT), pack(n[i:j].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                                                     names=["bucket", "block", "contexts", "words", "n"])

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("block")
        contexts, words = gathered(found["contexts"]), gathered(found["words"])
        n = [unpack(x, np.int32) for x in found["n"]]
        keys, of = np.unique(contexts[1] * len(words[0]) + words[1], return_inverse=True)
        total = np.bincount(of, np.concatenate(n), minlength=len(keys)).astype(np.int64)
        seen = total > 0
        context, word = np.divmod(keys, max(1, len(words[0])))
        before = np.cumsum(np.bincount(context[seen] + 1, minlength=len(contexts[0]) + 1))  # pairs of the contexts before each
        place = np.where(before[context + 1] > before[context], 2 * before[context] + 3, 1).astype(np.int32)
        context, word, total = context[seen], word[seen], total[seen]
        place[seen] = 2 * np.arange(len(total))
        places = [pack(x, STEPS) for x in np.split(place[of], np.cumsum([len(x) for x in n])[:-1])]
        row = (int(found["bucket"].iloc[0]), pack_distinct(contexts[0], context), pack_distinct(words[0], word), pack(total), list(found["block"]), places,
               *tallies((contexts[0], context), (words[0], word), np.ones(len(total), np.int64), classes))
        return pd.DataFrame([row], columns=[x.split()[0] for x in MERGED.split(", ")])

    dealt = blocks.select("block", "sizes", "held", "words", "vocabulary").mapInArrow(deal, "bucket int, block bigint, contexts binary, words binary, n binary")
    return dealt.groupBy("bucket").applyInPandas(merge, MERGED)


def _unpacked_rows(rows: DataFrame, columns: tuple[str, str], schema: str, size: int = 0) -> DataFrame:
    """A row for each number in two packed columns; with ``size``, the first one is split by it."""

    def run(parts):
        for batch in parts:
            for first, second in zip(*(batch.column(c).to_pylist() for c in columns)):
                first, second = unpack(first, np.int64), unpack(second, np.int64)
                keys = [(first // size).astype(np.int32), (first % size).astype(np.int32)] if size else [first]
                for at in range(0, len(first), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in (*keys, second)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select(*columns).mapInArrow(run, schema)


def class_cells(rows: DataFrame, classes: Classes) -> DataFrame:
    """``context, dish, n``: the tables of the words' restaurants by the classes of context and word."""
    each = _unpacked_rows(rows, ("cells", "cell_tables"), "context int, dish int, n bigint", len(classes))
    return each.groupBy("context", "dish").agg(F.sum("n").alias("n"))


def rare_customers(rows: DataFrame) -> DataFrame:
    """``word, c``: the tables of the words' restaurants by rare word."""
    return _unpacked_rows(rows, ("rare", "rare_tables"), "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def word_probabilities(words: DataFrame, rooms: RareRestaurants) -> DataFrame:
    """``word, c, p`` of ``words(word, c, seated)``: the decimal logarithm of a word's probability in its class."""

    def run(parts):
        for batch in parts:
            p = np.log10(rooms.probability(batch.column("word").to_numpy(), batch.column("seated").to_numpy())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p)], names=["word", "c", "p"])

    return words.select("word", "c", "seated").mapInArrow(run, "word bigint, c bigint, p float")


def resolved(rows: DataFrame, number: str) -> DataFrame:
    """``rows(place, c, p)`` and ``number``, packed by number."""

    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def row(found):
        c, p, at, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, at))
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        out = [(int(at[o[0]]), pack(place[o], STEPS), pack(c[o]), pack(p[o])) for o in np.split(order, cuts)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[number, "place", "c", "p"])

    def run(parts):
        found, total = [], 0
        for batch in parts:
            if batch.num_rows:
                found.append([batch.column(x).to_numpy() for x in ("c", "p", number, "place")])
                total += batch.num_rows
            if total >= PACKED:
                yield row(found)
                found, total = [], 0
        if found:
            yield row(found)

    return rows.select("c", "p", number, "place").mapInArrow(run, f"{number} bigint, place binary, c binary, p binary")


def with_parents(merged: DataFrame, classes: Classes, following, rooms: RareRestaurants, customers: DataFrame) -> DataFrame:
    """``bucket, contexts, words, n, parent``: with the parent's probability of each pair that comes twice or more."""

    def wanted(words: bytes, n: bytes) -> tuple[np.ndarray, ...]:
        """The distinct words and their classes, the word of each pair that comes twice or more, and which words of these are rare."""
        found, at = unpack_distinct(words, np.int64)
        at, kind, rare = at[unpack(n, np.int64) > 1], classes.of(found), np.zeros(len(found), bool)
        rare[at] = True
        return found, kind, at, rare & (kind >= len(classes.words))

    def ask(parts):
        for batch in parts:
            for bucket, words, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "n"))):
                found, _, _, rare = wanted(words, n)
                words = found[rare]
                for at in range(0, len(words), 1 << 16):
                    part = words[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), bucket, np.int64)), pa.array(np.arange(at, at + len(part), dtype=np.int32))],
                                                     names=["word", "bucket", "place"])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.itertuples():
            found, kind, at, rare = wanted(r.words, r.n)
            p = np.zeros(int(rare.sum()))
            for place, ps in zip(right["place"], right["p"]):
                p[unpack(place, np.int32)] = unpack(ps, np.float32)
            own = np.zeros(len(found))
            own[rare] = p
            contexts, of = unpack_distinct(r.contexts, np.int64)
            of = classes.of(contexts)[of[unpack(r.n, np.int64) > 1]]
            rows.append((r.bucket, r.contexts, r.words, r.n, pack((10.0 ** (following.value[of, kind[at]] + own[at])).astype(np.float32))))
        return pd.DataFrame(rows, columns=["bucket", "contexts", "words", "n", "parent"])

    asked = merged.select("bucket", "words", "n").mapInArrow(ask, "word bigint, bucket bigint, place int")
    found = resolved(asked.join(word_probabilities(customers.withColumn("seated", F.col("c")), rooms), "word"), "bucket")
    left = merged.select(F.col("bucket").cast("bigint").alias("bucket"), "contexts", "words", "n")
    return left.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(answer, "bucket bigint, contexts binary, words binary, n binary, parent binary")


class Bucket:
    """The pairs of a bucket and their seating."""

    def __init__(self, classes: Classes, contexts: bytes, words: bytes, n: bytes, parent: bytes):
        (self.contexts, self.room), (self.words, self.word) = (unpack_distinct(x, np.int64) for x in (contexts, words))
        self.n = unpack(n, np.int64)
        kind = classes.of(self.contexts)
        self.kind, self.frequent = kind[self.room], (kind < len(classes.words))[self.room]
        self.several = np.flatnonzero(self.n > 1)
        self.parent = unpack(parent, np.float32).astype(float)

    def of_frequent(self) -> tuple[bytes, ...]:
        """FREQUENT_PAIRS of the bucket, at the start: those that come twice or more, and the number of the others by class."""
        others = np.bincount(self.kind[self.frequent & (self.n == 1)]).astype(np.int64)
        chosen = self.frequent[self.several]
        at = self.several[chosen]
        own = pack(self.parent[chosen].astype(np.float32)), pack(self.n[at]), pack(self.kind[at].astype(np.int32))
        return (self.keys[chosen].tobytes(), *own, pack(np.ones(len(at), np.int64)), pack(np.arange(len(others))), pack(others), pack(others))

    @cached_property
    def keys(self) -> np.ndarray:
        return pair_keys(self.contexts[self.room[self.several]], self.words[self.word[self.several]])

    def summed(self, values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """For each pair the sum over its context; frequent contexts lie in many buckets, and their sums are given."""
        own = np.bincount(self.room, values, minlength=len(self.contexts))[self.room]
        return np.where(self.frequent, frequent[self.kind], own)

    def seated(self, tables: np.ndarray, before: np.ndarray, sweep: int) -> np.ndarray:
        """The tables of each pair after a sweep, given those of its whole context and its own before it."""
        discount, strength = WORDS
        opened = np.ones(len(self.n), np.int64)
        at = self.several
        opening = (strength + discount * (tables[at] - before[at])) * self.parent
        opened[at] = seat(self.n[at], opening, discount, self.keys, sweep, discount * self.parent)
        return opened


def word_sweeps(state: DataFrame, classes: Classes, customers: np.ndarray, tables: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """SEATED: what every pair has of its own and its context leaves to the parent, averaged over the sweeps behind the burn-in, and the last tables.

    ``customers`` and ``tables``: those of the frequent contexts, by class, at the start. Also what each frequent context leaves to the parent.
    """
    discount, strength = WORDS
    history = [tables]
    columns = ("contexts", "words", "n", "parent")
    kept = [x.split()[0] for x in FREQUENT_PAIRS.split(", ")]

    def record(values):
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=kept)

    def start(parts):
        for batch in parts:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                yield record(Bucket(classes, *row).of_frequent())

    pairs = stored(state.select(*columns).mapInArrow(start, FREQUENT_PAIRS), "frequent")
    for sweep in range(SWEEPS):

        def seat_again(parts, sweep=sweep, tables=tables):
            for batch in parts:
                for row in zip(*(batch.column(c).to_pylist() for c in kept)):
                    keys, parent, n, kind, opened = (f(x, k) for f, x, k in zip((np.frombuffer, *[unpack] * 4), row, (np.uint64, np.float32, np.int64, np.int32, np.int64)))
                    parent, others = parent.astype(float), unpack(row[7], np.int64)
                    opened = seat(n, (strength + discount * (tables[kind] - opened)) * parent, discount, keys, sweep, discount * parent)
                    total = np.bincount(kind, opened, minlength=len(classes)).astype(np.int64)
                    total[:len(others)] += others
                    kinds = np.flatnonzero(total)
                    yield record((*row[:4], pack(opened), pack(kinds), pack(total[kinds]), row[7]))

        after = stored(pairs.mapInArrow(seat_again, FREQUENT_PAIRS), "frequent")
        dropped(pairs)
        pairs, tables = after, np.zeros(len(classes))
        for kind, n in _unpacked_rows(pairs, ("kinds", "tables"), "kind bigint, n bigint").groupBy("kind").agg(F.sum("n")).collect():
            tables[kind] = n
        history.append(tables)
    dropped(pairs)

    def run(parts):
        for batch in parts:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns))):
                part = Bucket(classes, *row)
                total = strength + part.summed(part.n, customers)
                opened = np.ones(len(part.n), np.int64)
                own, share = np.zeros(len(part.n)), np.zeros(len(part.n))
                for sweep in range(SWEEPS):
                    opened = part.seated(part.summed(opened, history[sweep]), opened, sweep)
                    if sweep >= BURN_IN:
                        own += (part.n - discount * opened) / total
                        share += (strength + discount * part.summed(opened, history[sweep + 1])) / total
                sweeps = SWEEPS - BURN_IN
                values = (bucket, *(pack((x / sweeps).astype(np.float32), RUNS) for x in (own, share)), *tallies((part.contexts, part.room), (part.words, part.word), opened, classes))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), *[pa.binary()] * 6))], names=[x.split()[0] for x in SEATED.split(", ")])

    left = np.mean([(strength + discount * t) / (strength + customers) for t in history[BURN_IN + 1:]], axis=0)
    return state.select("bucket", *columns).mapInArrow(run, SEATED), left


def pair_replies(merged: DataFrame, seated: DataFrame) -> DataFrame:
    """``block, bucket, own, share``: for the pairs of a block in a bucket, in their order."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r, t in zip(left.itertuples(), right.itertuples()):
            own, share = unpack(t.own, np.float32), unpack(t.share, np.float32)
            own, share = (np.append(x, np.float32(y)) for x, y in ((own, 0), (share, 1)))  # the last one: a context never seen
            for block, place in zip(r.blocks, r.places):
                at, new = np.divmod(unpack(place, np.int32), 2)
                rows.append((block, r.bucket, pack(own[np.where(new, -1, at)], RUNS), pack(share[at - new], RUNS)))
        return pd.DataFrame(rows, columns=["block", "bucket", "own", "share"])

    left = merged.select("bucket", "blocks", "places").groupBy("bucket")
    return left.cogroup(seated.select("bucket", "own", "share").groupBy("bucket")).applyInPandas(run, "block bigint, bucket int, own binary, share binary")


# ---------------------------------------------------------------- scores

def scores(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """SCORED and ``train_tokens`` for ``documents(doc_id, text)``, a row for each row.

    What a step has stored goes as soon as the steps that read it have stored their own; the blocks, their words and the
    replies to their pairs stay, as the result reads them.
    """
    spark = documents.sparkSession
    blocks = stored(encoded(documents, block), "blocks")
    rows = placed_words(blocks)
    counts = stored(rows.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    trained, types = (x or 0 for x in counts.filter("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first())
    end = int(np.array([WordHash()[END]], np.uint64).view(np.int64)[0])
    top = counts.filter((F.col("c") > 0) & (F.col("word") != end)).orderBy(F.desc("c"), "word").limit(FREQUENT - 1)
    most = {r["word"]: r["c"] for r in top.collect()}
    most[end] = counts.filter(F.col("word") == end).agg(F.sum("c")).first()[0] or 0
    classes = Classes(list(most))
    customers = np.zeros(len(classes))  # a word is as often a context as it comes, and so is the end
    customers[classes.of(np.array(list(most), np.int64))] = list(most.values())

    def parent(tallied: DataFrame):
        """The parent's models of classes and of rare words, the rare words' customers, and the tables by class of context."""
        cells = stored(class_cells(tallied, classes), "cells")
        tables = np.zeros(len(classes))
        for kind, n in cells.groupBy("context").agg(F.sum("n")).collect():
            tables[kind] = n
        rare = stored(rare_customers(tallied), "rare")
        following = spark.sparkContext.broadcast(np.log10(context_sweeps(cells, len(classes))))
        rooms = rare_sweeps(rare, classes)
        dropped(cells)
        return following, rooms, rare, tables

    buckets = LEAST_BUCKETS + trained // BUCKET
    merged = stored(merged_pairs(blocks, classes, buckets), "pairs")
    following, rooms, rare, tables = parent(merged)
    state = stored(with_parents(merged, classes, following, rooms, rare), "parents")
    dropped(rare)
    seated, share_left = word_sweeps(state, classes, customers, tables)
    seated = stored(seated, "seated")
    dropped(state)
    following, rooms, rare, _ = parent(seated)
    replies = stored(pair_replies(merged, seated).withColumnRenamed("own", "c").withColumnRenamed("share", "p"), "replies")
    dropped(merged, seated)
    base = trained + 0.1 * (types + 1)

    seen = counts.join(rare.withColumnRenamed("c", "seated"), "word", "left").fillna(0, ["seated"])
    known = stored(resolved(rows.select("word", "block", "place").join(word_probabilities(seen, rooms), "word"), "block"), "known")
    dropped(counts, rare)
    known = known.withColumn("bucket", F.lit(-1)).unionByName(replies.withColumn("place", F.lit(None).cast("binary")))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: Iterator[pd.DataFrame] = []
        size = sum(len(x) for x in left["vocabulary"]) // 8
        c, p = np.zeros(size, np.int64), np.zeros(size)
        words, pairs = right[right["bucket"] < 0], right[right["bucket"] >= 0].sort_values("bucket")
        for place, cs, ps in zip(words["place"], words["c"], words["p"]):
            at = unpack(place, np.int32)
            c[at], p[at] = unpack(cs, np.int64), unpack(ps, np.float32)
        for _, row in left.iterrows():
            vocabulary = np.frombuffer(row["vocabulary"], np.int64)
            kind = classes.of(vocabulary)
            context, word, _, of = block_pairs(row["words"], vocabulary, classes, buckets)
            own, share = (np.concatenate([unpack(x, np.float32) for x in pairs[k]]).astype(float) for k in ("c", "p"))
            model = np.empty(len(own))
            for i in range(0, len(own), PACKED):  # else each step of the formula holds all pairs
                part = slice(i, i + PACKED)
                before, after = kind[context[part]], kind[word[part]]
                left_over = np.where(before < len(classes.words), share_left[before], share[part])
                model[part] = np.log10(own[part] + left_over * 10.0 ** (following.value[before, after].astype(float) + p[word[part]]))
            del context, word, own, share
            tokens, sizes = unpack(row["words"], np.int32), np.asarray(row["sizes"], np.int64)
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x[at], first) for x, at in (((c > 0).astype(np.int64), tokens), (np.log10((c + 0.1) / base), tokens), (model, of))]
            found.append(pd.DataFrame({
                "doc_id": pd.array(list(row["ids"]), dtype="Int64"), "held_out": list(row["held"]), "n_tokens": sizes,
                "n_known": sums[0], "base_score": sums[1], "score": sums[2],
            }))
        return pd.concat(found) if found else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    whole = blocks.select("block", "ids", "sizes", "held", "words", "vocabulary").groupBy("block").cogroup(known.groupBy("block"))
    return whole.applyInPandas(score, SCORED).select("*", F.lit(trained).cast("bigint").alias("train_tokens"))


def score_report(documents: DataFrame) -> DataFrame:
    return scores(documents).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (-F.col("score") / F.col("n_tokens") * F.log(F.lit(10.0))).alias("log_perplexity"),
    )
