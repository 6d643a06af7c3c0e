"""Benchmark decontamination: MinHash containment search with size partitions.

Which short items stand inside which long documents? Items are partitioned by their
number of shingles into classes [4^k, 4^(k+1)). For each class in use, documents are
cut into domains of the class's own size, 4^(k+1) shingles in a row, so that a short
item is always searched in domains of its own order of size, however long the
document: its Jaccard similarity with a domain it lies in never falls with the
document's length, as it does in a search over whole documents. A domain and an item
are candidates when they agree in any of HASHES MinHash values. An item cut in two by a
border, or scattered over many domains, agrees as often in sum: at containment 0.8 at
least 11 agreements are expected, so fewer than 1 in 50,000 such pairs is missed, and at
containment 1 fewer than 1 in a million. Candidates are confirmed by exact containment on
the words of the whole document.

Items are the stated query set and are taken in blocks of BLOCK, so what a task holds
is bounded; a document is looked at once for every block and shuffled never.

Shingles are five words in a row, lower-cased from A to Z; a text with fewer words is
one shingle. Defined cases: null or empty texts have no shingles, match nothing and
contaminate nothing; repeated items and documents give a row each; null ids are
kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import WordHash, byte_texts, free_name, shingle_hashes64, small, stored

WORDS = 5
THRESHOLD = (80, 100)
HASHES = 64
BLOCK = 20_000
GROWTH = 4
RESULT = "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint"
#: Odd multipliers; the MinHash values are minima of (multiplier x hash) modulo 2^32.
MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingles(words: list[bytes], size: int = WORDS) -> list[bytes]:
    """Every run of ``size`` words, joined by a blank; fewer words are one shingle, none are none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(words: list[bytes], cache: WordHash, size: int = WORDS) -> np.ndarray:
    """32-bit hashes of the shingles, in order."""
    return (shingle_hashes64(words, cache, size) >> np.uint64(32)).astype(np.uint32)


def size_class(n: int) -> int:
    """k with 4^k <= n < 4^(k+1)."""
    k = 0
    while GROWTH ** (k + 1) <= n:
        k += 1
    return k


def minima(hashes: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """For each hash function, the least value of every run of ``length`` hashes."""
    rows = hashes.reshape(-1, length)
    buffer = np.empty_like(rows)
    for a in MULTIPLIERS:
        yield np.multiply(rows, a, out=buffer).min(axis=1)


class ItemIndex:
    """One block of items: exact shingle sets, and per size class the MinHash values."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        cache = WordHash()
        self.ids, self.sets, self.classes = [], [], {}
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = text.lower().split()
            if not words:
                continue
            grams = frozenset(shingles(words))
            hashes = np.unique(shingle_hashes(words, cache))
            by_class.setdefault(size_class(len(grams)), []).append((len(self.ids), hashes))
            self.ids.append(item_id)
            self.sets.append(grams)
        for k, members in by_class.items():
            owners = np.array([i for i, _ in members])
            values = np.stack([(h[:, None] * MULTIPLIERS).min(axis=0) for _, h in members])
            index = []
            for j in range(HASHES):
                order = np.argsort(values[:, j], kind="stable")
                seen = np.zeros(1 << 16, bool)  # a first look at the upper half of a value
                seen[values[:, j] >> 16] = True
                index.append((seen, values[order, j], owners[order]))
            self.classes[k] = index

    def candidates(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) numbers that agree in a value; ``hashes`` are those of all documents in a row."""
        found: set[tuple[int, int]] = set()
        for k, index in self.classes.items():
            size = GROWTH ** (k + 1)
            domains = -(-lengths // size)
            owner = np.repeat(np.arange(len(lengths)), domains)
            if not len(owner):
                continue
            # A document's last domain is filled up with its last shingle, which changes no minimum.
            first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(domains) - domains, domains)) * size
            last = (starts + lengths - 1)[owner]
            for at in range(0, len(owner), max(1, (1 << 19) // size)):
                part = slice(at, at + max(1, (1 << 19) // size))
                places = np.minimum(first[part, None] + np.arange(size), last[part, None])
                block = hashes[places]
                for (seen, values, owners), least in zip(index, minima(block, size)):
                    likely = np.flatnonzero(seen[least >> np.uint32(16)])
                    if not len(likely):
                        continue
                    low, high = np.searchsorted(values, least[likely], "left"), np.searchsorted(values, least[likely], "right")
                    for i in np.flatnonzero(high > low):
                        doc = int(owner[part][likely[i]])
                        found.update((doc, int(o)) for o in owners[low[i]:high[i]])
        return found


def _search(index: ItemIndex):
    def run(parts):
        cache = WordHash()
        for batch in parts:
            ids = batch.column("doc_id").to_pylist()
            words = [t.lower().split() for t in byte_texts(batch.column("text"))]
            each = [shingle_hashes(w, cache) for w in words]
            lengths = np.array([len(h) for h in each], np.int64)
            hashes = np.concatenate(each) if each else np.empty(0, np.uint32)
            rows, last, grams = [], None, frozenset()
            for doc, item in sorted(index.candidates(hashes, np.cumsum(lengths) - lengths, lengths)):
                if doc != last:
                    last, grams = doc, set(shingles(words[doc]))
                wanted = index.sets[item]
                shared = len(wanted & grams)
                if THRESHOLD[1] * shared >= THRESHOLD[0] * len(wanted):
                    rows.append((ids[doc], index.ids[item], len(wanted), shared))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "item_shingles", "shared"]
                )

    return run


def item_blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in lists of at most ``size``; the driver holds one list and the next at a time."""
    block = []
    for row in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], (row[1] or "").encode()))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contained_items(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared``: items of which a document has at least 80 % of the shingles.

    ``documents(doc_id, text)``, ``items(item_id, text)``.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint"), "text")
    done, last = [], None
    for part in item_blocks(items, block):
        if last is not None:
            done.append(stored(texts.mapInArrow(small(_search(ItemIndex(last))), RESULT), "contained"))  # kept before the next index is built
        last = part
    if last is None:
        return spark.createDataFrame([], RESULT)
    found = texts.mapInArrow(small(_search(ItemIndex(last))), RESULT)
    if not done:
        return found
    done.append(stored(found, "contained"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return whole


def containment_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of document and contained item, with the item's and the shared number of shingles."""
    return contained_items(documents, items)


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is contained, with the same columns.

    Documents are told apart by ``doc_id``; rows without one are judged as one document.
    """
    hit = free_name(documents, "_hit")
    found = stored(contained_items(documents, items).select(F.col("doc_id").alias(hit)).distinct(), "contaminated")
    return documents.join(found, documents["doc_id"].eqNullSafe(found[hit]), "left_anti")
