"""Quality rules by robust multivariate outliers.

Every text becomes a short vector of transformed statistics. For each language and
source the location and scatter of the vectors are estimated by minimum covariance
determinant: the share SUBSET of the rows whose covariance has the least determinant. A row
is rejected when its Mahalanobis distance from that estimate is too large.

How the estimate is found, with all rows of a group and no group in one task:

* vectors are rounded to 1/UNIT, so that sums of values and of products are exact whole
  numbers, equal in any order of the rows;
* three deterministic starts (medians with MAD scales; spatial signs; hyperbolic tangents);
* a concentration step joins each row with its group's estimate, puts it into one of a
  bounded number of distance bins and sums count, values and products by group and bin,
  which Spark does in every task before the shuffle; the bins of a group, nearest first, up to the one
  that completes the subset, give the next estimate;
* two steps for each start, then steps from the best one until no determinant falls;
* one reweighting step over the rows within the 97.5 % quantile.

Every variance has a floor, as many statistics are equal for most texts of a group (no
symbols, no repeated lines) and the plain determinant would be zero.

Groups with fewer than LEAST_ROWS rows are pooled: those of a language together, and what is
still too small with all others; where even that is too small, its rows are judged by the estimate over all rows of the
table, whatever their number, so every row that passes the base rule has a distance.

Defined cases: null text has no words and fails the base rule; null language or source is a value
of its own; repeated rows count as often as they come; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import SPACES, byte_texts, small, stored

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
WINDOW = 5
UNIT = 256
SUBSET = 0.75
LEAST_ROWS = 60
#: A clean row is rejected about once in ten thousand, were the vectors of a group normal.
REJECT = 1 - 1e-4
#: The statistics and the least standard deviation of each.
STATISTICS = {
    "log_words": 0.15, "log_word_length": 0.06, "symbols": 0.2, "repeated": 0.06, "repeated_lines": 0.1, "capitals": 0.05,
    "log_line_words": 0.2,
}
P = len(STATISTICS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FACTS = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, " + ", ".join(f"x{i} int" for i in range(P))
#: The group of all rows, for pools that are too small.
EVERY = "every"
ESTIMATE = "grp string, start int, n bigint, mu array<double>, inverse array<double>, logdet double"


# ---------------------------------------------------------------- statistics

def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that come twice or more, first ones included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, upto)
            upto = i + size
    return covered


def base_statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, repeated words, lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    chars = sum(map(len, map(bytes.decode, words))) if not text.isascii() else len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def vector(n: int, chars: int, symbols: int, dup: int, repeat: int, lines: int, capitals: int) -> list[int]:
    """The transformed statistics in units of 1/UNIT."""
    if not n:
        return [0] * P
    values = (
        math.log1p(n), math.log(chars / n), math.log1p(100 * symbols / chars), math.sqrt(repeat / n), math.sqrt(dup / lines),
        math.sqrt(capitals / chars), math.log1p(n / lines),
    )
    return [round(v * UNIT) for v in values]


def facts(documents: DataFrame) -> DataFrame:
    """The base statistics and vectors of ``documents(doc_id, lang, source, text)``, a row for each row."""

    def run(parts):
        for batch in parts:
            rows = []
            for text in byte_texts(batch.column("text")):
                n, chars, symbols, dup, repeat, lines = base_statistics(text)
                capitals = len(text) - len(text.translate(None, CAPITALS))
                failed = n < 10 or 100 * repeat > 20 * n
                rows.append((n, chars, symbols, dup, repeat, failed, *vector(n, chars, symbols, dup, repeat, lines, capitals)))
            columns = list(zip(*rows)) or [()] * (6 + P)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int32()] * P
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
            )

    chosen = documents.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return chosen.mapInArrow(small(run), FACTS)


# ---------------------------------------------------------------- groups

def _key(*names: str) -> Column:
    """One text for several values, different for different values, null among them."""
    return F.concat(*(F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), F.col(n)), F.lit("-")) for n in names))


def grouped(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` with ``grp``: language and source, or a pool of small groups, or EVERY where that is too small; null if no row of the pair is usable."""
    sizes = rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.withColumn("pair", _key("lang", "source")).withColumn("one", _key("lang")), "sizes")
    small = sizes.filter(F.col("n") < least).groupBy("one").agg(F.sum("n").alias("small"))
    left = small.filter(F.col("small") < least).agg(F.sum("small")).first()[0] or 0
    rest = F.lit("rest" if left >= least else EVERY)
    chosen = sizes.join(small, "one", "left").select("pair", F.when(F.col("n") >= least, F.concat(F.lit("pair "), "pair"))
                                                     .when(F.col("small") >= least, F.concat(F.lit("language "), "one"))
                                                     .otherwise(rest).alias("grp"))
    return rows.withColumn("pair", _key("lang", "source")).join(chosen, "pair", "left").drop("pair")


# ---------------------------------------------------------------- chi-square

def chi_square_cdf(x: float, p: int) -> float:
    """The regularised lower incomplete gamma function at (p/2, x/2), by its series."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    if z > 200 + 10 * a:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, p) < q else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied by."""
    return share / max(chi_square_cdf(chi_square_quantile(share, P), P + 2), 1e-9) if share < 1 else 1.0


# ---------------------------------------------------------------- estimates

X = [f"x{i}" for i in range(P)]
FLOORS = np.array([(s * UNIT) ** 2 for s in STATISTICS.values()])


def estimate(n: int, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[list[float], list[float], float]:
    """Location, inverse scatter (upper triangle, off-diagonal terms doubled) and log determinant."""
    mu = sums / n
    scatter = np.empty((P, P))
    for (i, j), v in zip(PAIRS, products):
        scatter[i, j] = scatter[j, i] = v / n - mu[i] * mu[j]
    scatter = scatter * factor + np.diag(FLOORS)
    return _packed(mu, scatter)


def _packed(mu: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    inverse = np.linalg.inv(scatter)
    flat = [float(inverse[i, j] * (1 if i == j else 2)) for i, j in PAIRS]
    return [float(m) for m in mu], flat, float(np.linalg.slogdet(scatter)[1])


def distance() -> Column:
    """The squared Mahalanobis distance of a row's vector from the estimate beside it."""
    terms = [
        F.col("inverse")[k] * (F.col(X[i]) - F.col("mu")[i]) * (F.col(X[j]) - F.col("mu")[j]) for k, (i, j) in enumerate(PAIRS)
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _sums() -> list[Column]:
    wide = [F.col(x).cast("bigint") for x in X]
    return [
        F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x) for x in wide)).alias("sums"),
        F.array(*(F.sum(wide[i] * wide[j]) for i, j in PAIRS)).alias("products"),
    ]


def starts(vectors: DataFrame) -> DataFrame:
    """Three estimates for each group."""
    middle = vectors.groupBy("grp").agg(F.array(*(F.percentile(F.col(x), 0.5) for x in X)).alias("median"))
    middle = stored(middle, "medians")
    off = [F.abs(F.col(x) - F.col("median")[i]) for i, x in enumerate(X)]
    spread = vectors.join(middle, "grp").groupBy("grp").agg(F.array(*(F.percentile(o, 0.5) for o in off)).alias("mad"))
    spread = stored(middle.join(spread, "grp"), "spreads")
    z = [(F.col(x) - F.col("median")[i]) / F.sqrt(F.pow(1.4826 * F.col("mad")[i], 2) + float(FLOORS[i])) for i, x in enumerate(X)]
    near = vectors.join(spread, "grp").select("grp", "median", "mad", F.array(*z).alias("z"))
    size = F.sqrt(F.aggregate("z", F.lit(0.0), lambda t, v: t + v * v))
    near = near.withColumn("size", F.greatest(size, F.lit(1e-9)))
    whole = lambda c: F.sum(F.round(c * 1e6).cast("bigint"))  # noqa: E731  whole numbers add up alike in any order
    found = near.groupBy("grp", "median", "mad").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(whole(F.col("z")[i] / F.col("size") * F.col("z")[j] / F.col("size")) for i, j in PAIRS)).alias("signs"),
        F.array(*(whole(F.tanh(F.col("z")[i]) * F.tanh(F.col("z")[j])) for i, j in PAIRS)).alias("tangents"),
    )

    def run(parts):
        for batch in parts:
            rows = []
            for row in batch.to_dict("records"):
                scale = np.sqrt((1.4826 * np.asarray(row["mad"])) ** 2 + FLOORS)
                mu = np.asarray(row["median"], float)
                for start, sums in enumerate((None, row["signs"], row["tangents"])):
                    shape = np.eye(P)
                    if sums is not None:
                        for (i, j), v in zip(PAIRS, sums):
                            shape[i, j] = shape[j, i] = v / 1e6 / row["n"]
                        shape += 1e-3 * np.eye(P)  # signs of a single direction would be singular
                        own = np.sqrt(np.diag(shape))
                        shape = shape / np.outer(own, own)
                    rows.append((row["grp"], start, row["n"], *_packed(mu, shape * np.outer(scale, scale))))
            yield pd.DataFrame(rows, columns=["grp", "start", "n", "mu", "inverse", "logdet"])

    return few(found).mapInPandas(run, ESTIMATE)


def concentrate(vectors: DataFrame, estimates: DataFrame, share: float = SUBSET) -> DataFrame:
    """One concentration step for every estimate."""
    # 64 bins for each doubling: distances in a bin differ by about one in a hundred.
    place = F.floor(64 * F.log2(1 + distance())).cast("int")
    bins = vectors.join(estimates, "grp").select("grp", "start", place.alias("place"), *X).groupBy("grp", "start", "place").agg(*_sums())

    # A group's bins are bounded: no distance needs more than some thousands.
    together = bins.groupBy("grp", "start").agg(F.array_sort(F.collect_list(F.struct("place", "n", "sums", "products"))).alias("bins"))

    def run(parts):
        for batch in parts:
            rows = []
            for grp, start, found in zip(batch["grp"], batch["start"], batch["bins"]):
                counts = np.array([b["n"] for b in found])
                total = int(counts.sum())
                upto = int(np.searchsorted(np.cumsum(counts), math.ceil(share * total))) + 1
                n = int(counts[:upto].sum())
                sums, products = (np.array([b[c] for b in found[:upto]], float).sum(axis=0) for c in ("sums", "products"))
                rows.append((grp, start, total, *estimate(n, sums, products, consistency(n / total))))
            yield pd.DataFrame(rows, columns=["grp", "start", "n", "mu", "inverse", "logdet"])

    return few(together).mapInPandas(run, ESTIMATE)


def few(groups: DataFrame) -> DataFrame:
    """A row for each group in no more partitions than there are cores, so that no Python worker is started for an empty one."""
    return groups.coalesce(max(1, groups.sparkSession.sparkContext.defaultParallelism))


def reweighted(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimate from all rows within the 97.5 % quantile of the given one."""
    share = 0.975
    inside = vectors.join(estimates, "grp").filter(distance() <= chi_square_quantile(share, P))
    sums = inside.groupBy("grp").agg(*_sums())

    def run(parts):
        for batch in parts:
            rows = [(r["grp"], 0, r["n"], *estimate(r["n"], np.asarray(r["sums"], float), np.asarray(r["products"], float), consistency(share)))
                    for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=["grp", "start", "n", "mu", "inverse", "logdet"])

    return few(sums).mapInPandas(run, ESTIMATE)


def converged(vectors: DataFrame, now: DataFrame, share: float = SUBSET) -> DataFrame:
    """Concentration steps until no determinant falls; a group keeps its estimate when a step doesn't lower its determinant."""
    while True:
        following = concentrate(vectors, now, share).alias("a").join(now.alias("b"), "grp")
        falls = F.col("a.logdet") < F.col("b.logdet") - 1e-9
        columns = ("start", "n", "mu", "inverse", "logdet")
        now = stored(following.select("grp", *(F.when(falls, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns), falls.alias("fell")), "concentrated")
        fell, now = now.filter("fell").limit(1).count(), now.drop("fell")
        if not fell:
            return now


def covariance_estimates(vectors: DataFrame, share: float = SUBSET) -> DataFrame:
    """``grp, start, n, mu, inverse, logdet`` of ``vectors(grp, x0, x1, ...)``."""
    now = stored(starts(vectors), "starts")
    for _ in range(2):
        now = stored(concentrate(vectors, now, share), "concentrated")
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", "n", "mu", "inverse", "logdet"), F.struct("logdet", "start")).alias("b"))
    now = stored(best.select("grp", "b.*"), "best")
    return stored(reweighted(vectors, converged(vectors, now, share)), "reweighted")


def outlier_report(documents: DataFrame, share: float = SUBSET, least: int = LEAST_ROWS) -> DataFrame:
    """Base statistics, ``base_failed``, ``kept`` and ``distance`` of each row; null only for rows that fail the base rule where none of their language and source passes."""
    rows = stored(grouped(stored(facts(documents), "facts"), least), "vectors")
    usable = rows.filter(~F.col("base_failed") & F.col("grp").isNotNull())
    vectors = usable.select("grp", *X).filter(F.col("grp") != EVERY)
    if usable.filter(F.col("grp") == EVERY).limit(1).count():
        vectors = vectors.unionAll(usable.select(F.lit(EVERY).alias("grp"), *X))
    estimates = covariance_estimates(vectors, share).select("grp", "mu", "inverse")
    judged = rows.join(estimates, "grp", "left").withColumn("distance", F.when(F.col("mu").isNotNull(), distance()))
    fine = F.coalesce(F.col("distance") <= chi_square_quantile(REJECT, P), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fine).alias("kept"), "distance",
    )
