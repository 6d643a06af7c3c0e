import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, vector array<double>, rank int, score double"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, y, v, 3, 0.5) for i, y, v in rows], SCHEMA)


def brute(rows, positives=5, negatives=5, low=80, high=100):
    fit = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    one = {}
    for i, y, v in sorted((i, y, [math.floor(256 * x) for x in v]) for i, y, v in fit):
        one.setdefault(i, (y, v))
    out = []
    for a, (label, v) in one.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, y) for i, (y, w) in one.items() if i != a)
        for p, positive, y in [s for s in scores if s[2] == label][:positives]:
            inside = [(s, i) for s, i, y in scores if y != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, positive, k, i, -p, -s) for k, (s, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    vectors = hn.integer_vectors(rows_of(spark, rows))
    return sorted(tuple(r) for r in hn.hard_negatives(vectors, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("rows, inner, columns", [(1, 1, 1), (64, 64, 64), (65, 33, 97), (130, 5, 70), (100, 64, 257)])
@pytest.mark.parametrize("most", [50, 1 << 28])
def test_strassen(rows, inner, columns, most):
    r = np.random.default_rng(rows)
    a, b = r.integers(-most, most, (rows, inner)), r.integers(-most, most, (inner, columns))
    assert (hn.strassen(a, b, 8) == a @ b).all() and (hn.strassen(a, b) == a @ b).all()


@pytest.mark.parametrize("options", [{}, {"tile": 200, "block": 16}, {"positives": 2, "negatives": 1, "low": 10, "high": 90}])
def test_equals_all_scores(spark, options):
    r = np.random.default_rng(7)
    rows = [(int(i), int(r.integers(0, 3)), np.abs(r.normal(size=8)).round(1).tolist()) for i in range(600)]
    rows += [(int(i), 1, [0.5] * 8) for i in range(1000, 1200)]  # equal vectors
    found = mined(spark, rows, **options)
    assert found == brute(rows, **{k: v for k, v in options.items() if k not in ("tile", "block")}) and found


def test_edge_cases(spark):
    rows = [(0, 1, [1.0, 0.0]), (100, 2, [0.5, 0.5, 0.25]), (1, 1, [0.9, 0.1]), (1, 1, [0.9, 0.1]), (1, 3, [9.0, 9.0]), (2, 2, [0.8, 0.1]), (3, 2, [1.0]),
            (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (None, 2, [1.0, 1.0]),
            (9, 1, []), (200, 5, [1.0, 1.0]), (300, 1, [-1.0, -1.0]), (10, 1, [0.0, -0.001])]
    assert mined(spark, rows) == brute(rows)


def test_without_rows_or_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [1.0])]) == []


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e12]), (1, 1, [1e12])])


def test_heaps_keep_the_best_with_the_smaller_ids():
    heaps = hn.Heaps(2, 2)
    heaps.add(np.array([0, 0, 1]), np.array([5, 7, 1]), np.array([1, 2, 3]))
    heaps.add(np.array([0, 0, 1]), np.array([7, 6, 1]), np.array([4, 5, 6]))
    assert list(zip(heaps.heap.tolist(), heaps.score.tolist(), heaps.ident.tolist())) == [(0, 7, 2), (0, 7, 4), (1, 1, 3), (1, 1, 6)]
    assert heaps.least.tolist() == [7, 1]
