"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors: one for each of its words and one for
each character n-gram of its words, ends of words included, all hashed into BUCKETS
rows. A word equal to the one before it has one feature more, the mark of a repetition. The average goes through
a softmax layer; vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample (SAMPLE documents a class).

The layer is linear, so a word's share in a document's score is one number (the sum of its
features' vectors along the layer's direction) and is kept for words seen; documents are scored whole.

Defined cases: null or empty texts average to the zero vector; repeated rows are scored
alike, null ids are held out; without labelled documents of both classes every score is 0.5;
other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm import labelled
from vigilog.llm.common import byte_texts, held_out, small

BUCKETS = 1 << 18
SIZES = (3, 4)
DIM = 8
EPOCHS = 12
RATE = 2.0
SAMPLE = {1: 3000, 0: 3000}
AGAIN = b"<again>"
KEPT_WORDS = 300_000
SCORES = "doc_id bigint, n_words bigint, score double"


def features(word: bytes) -> list[int]:
    """Rows of a word and of its character n-grams; a word that is a mark of its own has one row."""
    found = [zlib.crc32(word) % BUCKETS]
    spelled = f"<{word.decode()}>"
    for size in SIZES:
        found += [zlib.crc32(spelled[i:i + size].encode()) % BUCKETS for i in range(len(spelled) - size + 1)]
    return found


def repetitions(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


class Embeddings(NamedTuple):
    """What the training gives: a number for each row (or None), the layer's shift."""

    rows: np.ndarray | None
    shift: float


class WordShares(dict):
    """The place of each word in two growing arrays: its features' sum and their number."""

    def __init__(self, rows: np.ndarray):
        super().__init__()
        self.rows = rows
        self.sums, self.sizes = np.zeros(1 << 12), np.zeros(1 << 12)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.sums):
            self.sums, self.sizes = np.resize(self.sums, 2 * n), np.resize(self.sizes, 2 * n)
        ids = features(word)
        self.sums[n], self.sizes[n] = self.rows[ids].sum(), len(ids)
        self[word] = n
        return n


def score(model: Embeddings, shares: WordShares, text: bytes) -> tuple[int, float]:
    words = text.split()
    if model.rows is None:
        return len(words), 0.5
    total = size = 0.0
    if words:
        if len(shares) > KEPT_WORDS:
            shares.clear()
        at = np.fromiter(map(shares.__getitem__, words), np.int64, len(words))
        again = repetitions(words)
        total = float(shares.sums[at].sum()) + again * float(model.rows[zlib.crc32(AGAIN) % BUCKETS])
        size = float(shares.sizes[at].sum()) + again
    z = total / max(size, 1.0) + model.shift
    return len(words), float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def counted(pieces: Iterable[bytes], known: dict[bytes, list[int]]) -> dict[int, int]:
    """How often a text, given in pieces, has each feature; ``known`` keeps the features of words."""
    counts: dict[int, int] = {}
    last: list[bytes] = []
    for piece in pieces:
        words = piece.split()
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) > KEPT_WORDS:
                    known.clear()
                ids = known[w] = features(w)
            for i in ids:
                counts[i] = counts.get(i, 0) + 1
        if again := repetitions(last + words):
            mark = zlib.crc32(AGAIN) % BUCKETS
            counts[mark] = counts.get(mark, 0) + again
        last = words[-1:] or last
    return counts


def gradients(rows: np.ndarray, weights: np.ndarray, layer: np.ndarray, shift: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the label's log-probability, by the layer, its shift and the rows of a text's features."""
    mean = weights @ rows
    z = layer @ mean + shift
    p = np.exp(z - z.max())
    error = -p / p.sum()
    error[label] += 1
    return np.outer(error, mean), error, weights[:, None] * (layer.T @ error)


def fit(rows: list[tuple[int, int, dict[int, int]]], seed: int = 4) -> Embeddings:
    """Vectors and layer from (rank, label, counts of features) rows, in the order of their ranks."""
    rows = sorted(rows, key=lambda r: r[:2])
    share = {label: sum(1 for r in rows if r[1] == label) for label in (0, 1)}
    if not share[0] or not share[1]:
        return Embeddings(None, 0.0)
    random = np.random.default_rng(seed)
    docs = []
    for _, label, counts in rows:
        n = max(1, sum(counts.values()))
        docs.append((label, np.fromiter(counts, np.int32, len(counts)), (np.fromiter(counts.values(), np.float32, len(counts)) / n)))
    vectors = ((random.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM)
    layer, shift = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for d in random.permutation(len(docs)):
            label, ids, weights = docs[d]
            rate = RATE * (1 - done / steps)
            done += 1
            to_layer, to_shift, to_rows = gradients(vectors[ids], weights, layer, shift, label)
            layer += rate * to_layer
            shift += 0.1 * rate * to_shift
            vectors[ids] += rate * to_rows
    direction = layer[1] - layer[0]
    return Embeddings((vectors @ direction).astype(np.float32), float(shift[1] - shift[0]))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> bytes:
    """The pickled model, fitted in one task on the bounded sample."""
    rows = labelled.sample(documents, labels, label, SAMPLE)

    def run(parts):
        known: dict[bytes, list[int]] = {}
        got = [(rank, label, counted(pieces, known)) for rank, label, pieces in labelled.documents_of(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(fit(got)))], pa.binary())], names=["model"])

    found = labelled.in_pieces(rows).mapInArrow(small(run), "model binary").first()
    return found["model"] if found else pickle.dumps(tuple(fit([])))  # an empty sample has no task


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, score`` for ``documents(doc_id, text)`` and ``labels(doc_id, quality)``."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(parts):
        trained = Embeddings(*pickle.loads(model.value))
        shares = WordShares(trained.rows)
        for batch in parts:
            found = [score(trained, shares, t) for t in byte_texts(batch.column("text"))]
            n, value = zip(*found) if found else ((), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(value, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(small(run), SCORES)


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(documents, labels).select(
        "doc_id", held_out("doc_id", labelled.FOLDS).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_words",
    )
