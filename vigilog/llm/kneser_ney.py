"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, spell words: each
character of a word is predicted from up to ORDER - 1 characters before it in the word.
The highest order is a class's own, discounted; what the discount frees goes to the
lower orders, and these are shared: continuation counts over the words of both
classes. So a rare expression that neither class has seen is spelled alike by both and
tells nothing, while new endings of a known stem count.

A word's evidence is the difference of its two log-likelihoods, as far as it goes beyond a
margin that MARGIN_SHARE of the words of ordinary documents pass: most words differ by chance, and
their sum would drown the few that matter in a long text. A document's value is the sum of its distinct words'
evidence divided by their number; the models too count a word once a document, so that a line
repeated in one document is no more than one sign. A logistic curve over the logarithm of the value, fitted like the margin on
documents of the sample that the counts have not seen, makes it a probability.

The models are fitted on a bounded sample (SAMPLE documents a class); all documents are scored whole.

Defined cases: null or empty texts have the value 0 and its score; repeated rows are scored alike, null ids are
held out; without labelled documents of both classes every score is 0; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm import labelled
from vigilog.llm.common import byte_texts, held_out, small

ORDER = 8
DISCOUNT = 0.75
#: Taken off every count of a class's own, so that what a class has shown a few times by chance counts as shared.
CLASS_DISCOUNT = 2.0
SAMPLE = {1: 2500, 0: 4000}
#: Of the sample, the share that fits the curve and not the counts.
CURVE_SHARE = 0.25
MARGIN_SHARE = 1e-4
#: Added to a value before its logarithm is taken.
LEAST_VALUE = 1e-4
KEPT_WORDS = 300_000
SCORES = "doc_id bigint, n_words bigint, value double, score double"


def grams(word: str) -> Iterator[str]:
    """Each character with up to ORDER - 1 before it; ``<`` and ``>`` are a word's ends."""
    spelled = f"<{word}>"
    for end in range(2, len(spelled) + 1):
        yield spelled[max(0, end - ORDER):end]


class Shared:
    """Kneser-Ney with continuation counts over the distinct grams of both classes."""

    def __init__(self, distinct: set[str]):
        self.count: list[Counter] = [Counter() for _ in range(ORDER)]
        self.total: list[Counter] = [Counter() for _ in range(ORDER)]
        self.kinds: list[Counter] = [Counter() for _ in range(ORDER)]
        level = distinct
        for n in range(ORDER - 1, 0, -1):
            shorter = Counter(g[-n:] for g in level if len(g) > n)  # how many different characters come before
            self.count[n] = shorter
            for g, c in shorter.items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1
            level = set(shorter) | {g for g in level if len(g) <= n}
        self.letters = max(1, len({g[-1] for g in distinct}))
        self.known: dict[str, float] = {}

    def probability(self, gram: str) -> float:
        """Of the last character behind those before it, all of lower order."""
        if not gram:
            return 1.0 / self.letters
        found = self.known.get(gram)
        if found is None:
            n, before = len(gram), gram[:-1]
            total = self.total[n].get(before, 0)
            rest = self.probability(gram[1:]) if n > 1 else 1.0 / self.letters
            if total:
                own = max(self.count[n].get(gram, 0) - DISCOUNT, 0.0) / total
                rest = own + DISCOUNT * self.kinds[n][before] / total * rest
            found = self.known[gram] = rest
        return found


class Ratio:
    """Log-likelihood ratios of grams and words, toxic over ordinary.

    ``seen`` has the grams of either class; others have the ratio in ``unseen`` of what comes before
    their last character, as the shared part of both probabilities is the same.
    """

    def __init__(self, seen: dict[str, float], unseen: dict[str, float]):
        self.seen, self.unseen = seen, unseen

    @classmethod
    def fitted(cls, words: dict[int, Counter]) -> "Ratio":
        counts: dict[int, Counter] = {}
        for label, own in words.items():
            counts[label] = Counter()
            for word, n in own.items():
                for g in grams(word):
                    counts[label][g] += n
        shared = Shared(set(counts[0]) | set(counts[1]))
        total = {label: defaultdict(int) for label in counts}
        freed = {label: defaultdict(float) for label in counts}
        for label, own in counts.items():
            for g, n in own.items():
                total[label][g[:-1]] += n
                freed[label][g[:-1]] += min(n, CLASS_DISCOUNT)
        rest = lambda label, before: freed[label][before] / total[label][before] if before in total[label] else 1.0
        unseen = {b: math.log(rest(1, b) / rest(0, b)) for b in set(total[0]) | set(total[1])}
        unseen = {b: r for b, r in unseen.items() if r}
        seen = {}
        for g in {g for own in counts.values() for g, n in own.items() if n > CLASS_DISCOUNT}:  # others are as if unseen
            before, lower = g[:-1], shared.probability(g[1:])
            p = [rest(label, before) * lower + (max(counts[label].get(g, 0) - CLASS_DISCOUNT, 0.0) / total[label][before] if before in total[label] else 0.0) for label in (0, 1)]
            seen[g] = math.log(p[1] / p[0])
        return cls(seen, unseen)

    def word(self, word: str) -> float:
        total = 0.0
        for g in grams(word):
            found = self.seen.get(g)
            total += self.unseen.get(g[:-1], 0.0) if found is None else found
        return total


class Scorer:
    """A ratio with its word cache, the margin and the curve."""

    def __init__(self, ratio: Ratio | None, margin: float = 0.0, slope: float = 0.0, shift: float = 0.0):
        self.ratio, self.margin, self.slope, self.shift, self.words = ratio, margin, slope, shift, {}

    def state(self) -> tuple:
        """Plain data that a scorer can be made from again."""
        grams = (self.ratio.seen, self.ratio.unseen) if self.ratio else None
        return grams, self.margin, self.slope, self.shift

    @classmethod
    def of(cls, state: tuple) -> "Scorer":
        grams, *rest = state
        return cls(Ratio(*grams) if grams else None, *rest)

    def differences(self, words: list[bytes]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for w in words:
            value = known.get(w)
            if value is None:
                value = known[w] = self.ratio.word(w.decode())
            out.append(value)
        return np.array(out)

    def document(self, text: bytes) -> tuple[int, float, float]:
        """Number of words, evidence by word, score."""
        words = text.lower().split()
        if self.ratio is None:
            return len(words), 0.0, 0.0
        value = float(np.maximum(self.differences(list(set(words))) - self.margin, 0.0).mean()) if words else 0.0
        z = self.slope * math.log(value + LEAST_VALUE) + self.shift
        return len(words), value, 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method; x is scaled first."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(rows: list[tuple[int, int, str]]) -> Scorer:
    """A scorer from (rank, label, text) rows."""
    rows = sorted(rows)
    parts = {label: [t for _, y, t in rows if y == label] for label in (0, 1)}
    if not parts[0] or not parts[1]:
        return Scorer(None)
    words: dict[int, Counter] = {}
    curve = []
    for label, texts in parts.items():
        cut = max(1, round(len(texts) * (1 - CURVE_SHARE)))
        words[label] = Counter()
        for t in texts[:cut]:
            words[label].update(set(t.encode().lower().split()))
        words[label] = Counter({w.decode(): n for w, n in words[label].items()})
        curve += [(label, t) for t in (texts[cut:] or texts)]
    scorer = Scorer(Ratio.fitted(words))
    ordinary = [scorer.differences(list(set(t.encode().lower().split()))) for label, t in curve if label == 0]
    ordinary = np.concatenate([np.zeros(1), *ordinary])
    scorer.margin = max(0.0, float(np.quantile(ordinary, 1 - MARGIN_SHARE)))
    x = np.log([scorer.document(t.encode())[1] + LEAST_VALUE for _, t in curve])
    scorer.slope, scorer.shift = logistic(x, np.array([float(label) for label, _ in curve]))
    return scorer


def train(documents: DataFrame, labels: DataFrame) -> bytes:
    """The pickled scorer, fitted in one task on the bounded sample."""
    rows = labelled.sample(documents, labels, "toxic", SAMPLE)

    def run(parts):
        # The models see a word of a document once, so its distinct words stand for it.
        got = [(rank, label, b" ".join(sorted(set().union(*(p.lower().split() for p in pieces)))).decode()) for rank, label, pieces in labelled.documents_of(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got).state())], pa.binary())], names=["model"])

    found = labelled.in_pieces(rows).mapInArrow(small(run), "model binary").first()
    return found["model"] if found else pickle.dumps(fit([]).state())  # an empty sample has no task


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, value, score`` for ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(parts):
        scorer = Scorer.of(pickle.loads(model.value))
        for batch in parts:
            found = [scorer.document(t) for t in byte_texts(batch.column("text"))]
            n, value, score = zip(*found) if found else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(value, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "value", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(small(run), SCORES)


def ordinary_documents(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose texts score under ``least``, with all columns, in one pass over them."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(parts):
        scorer = Scorer.of(pickle.loads(model.value))
        for batch in parts:
            keep = [scorer.document(t)[2] < least for t in byte_texts(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(small(run), documents.schema)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(documents, labels)
    return scored.select(
        "doc_id", held_out("doc_id", labelled.FOLDS).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "value", "n_words",
    )
