import math

import numpy as np
import pytest
from helpers_llm import prose  # noqa: F401

from vigilog.llm import robust_outliers as ro


def brute_repeated(words):
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)})


@pytest.mark.parametrize("seed", range(6))
def test_base_statistics(prose, seed):
    words = prose(60, seed, 4)
    text = "\n".join(" ".join(words[i:i + 7]) for i in range(0, 60, 7)) + "\n é#|　x \n\n" + " ".join(words[:7]) + "\n \t"
    n, chars, symbols, dup, repeat, lines = ro.base_statistics(text.encode())
    split = text.encode().split()
    full = [x for x in text.split("\n") if x.strip(" \t")]
    assert (n, repeat) == (len(split), brute_repeated(split))
    assert chars == sum(len(w.decode()) for w in split)
    assert symbols == 2
    assert (dup, lines) == (len(full) - len(set(full)), len(full))


def test_chi_square():
    # Known quantiles of two degrees of freedom: -2 ln(1 - q).
    for q in (0.1, 0.5, 0.975, 1 - 1e-6):
        assert math.isclose(ro.chi_square_quantile(q, 2), -2 * math.log(1 - q), rel_tol=1e-6)


def table(spark, points, group="g"):
    rows = [(group, *(int(round(v * ro.UNIT)) for v in p)) for p in points]
    return spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} int" for x in ro.X)).repartition(4)


def test_estimate_resists_a_quarter_of_outliers(spark):
    r = np.random.default_rng(1)
    clean = r.normal(size=(600, ro.P)) + np.arange(ro.P)
    dirty = r.normal(size=(150, ro.P)) * 0.2 + 9
    row = ro.covariance_estimates(table(spark, np.concatenate([clean, dirty]))).first()
    assert np.allclose(np.array(row["mu"]) / ro.UNIT, np.arange(ro.P), atol=0.25)


def test_a_step_never_raises_the_determinant_and_ignores_order(spark):
    r = np.random.default_rng(2)
    points = r.normal(size=(300, ro.P))
    one, two = table(spark, points), table(spark, points[::-1].copy()).repartition(7)
    first = ro.stored(ro.starts(one), "s")
    again = ro.concentrate(one, ro.concentrate(one, first)).orderBy("start").collect()
    other = ro.concentrate(two, ro.concentrate(two, ro.stored(ro.starts(two), "s"))).orderBy("start").collect()
    assert again == other
    third = ro.concentrate(one, spark.createDataFrame(again, ro.ESTIMATE)).orderBy("start").collect()
    assert all(b["logdet"] <= a["logdet"] + 0.02 for a, b in zip(again, third))  # bins are one hundredth wide


def test_edge_cases(spark, prose):
    rows = [(i, " ".join(prose(80, i)) + ".", "en", f"s{i % 2}") for i in range(160)]
    rows += [(900, " ".join(w + "%%%" for w in prose(80, 3)), "en", "s0"), (901, None, "en", "s0"), (902, "", None, None), (None, "a b", None, "s1")]
    rows += [rows[5], (903, " ".join(prose(50_000, 7, 9000)), "en", "s1"), (904, "a b c d e f g h i j k", None, None)]
    found = ro.outlier_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), least=40).collect()
    kept = {(r["doc_id"], r["kept"]) for r in found}
    assert len(found) == len(rows)
    assert {(900, False), (901, False), (902, False), (None, False), (904, False)} <= kept
    assert sum(r["kept"] for r in found) >= 160
    assert all(r["distance"] is not None for r in found if not r["base_failed"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert ro.outlier_report(empty).collect() == []


def test_one_statistic_past_the_cut_rejects(spark, prose):
    rows = [(i, " ".join(prose(100, i)) + ".", "en", "s") for i in range(200)]
    marked = [w + "%" * (i % 5 < 2) for i, w in enumerate(prose(100, 901))]  # about 8 symbols in 100 characters
    phrase = prose(5, 7, 4000)
    repeating = prose(34, 902) + phrase + prose(30, 903) + phrase + prose(30, 904) + phrase + prose(1, 905)  # 15 of 110 words repeat
    rows += [(901, " ".join(marked), "en", "s"), (902, " ".join(repeating) + ".", "en", "s")]
    found = {r["doc_id"]: r for r in ro.outlier_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not found[901]["base_failed"] and not found[901]["kept"]
    assert not found[902]["base_failed"] and not found[902]["kept"]
    assert sum(found[i]["kept"] for i in range(200)) >= 198


def test_lines_that_are_nearly_all_repeated_reject(spark):
    r = np.random.default_rng(4)
    points = r.normal(size=(300, ro.P)) * 0.1
    points[:, [2, 3, 4]] = 0  # no symbols, no repeated words or lines
    row = ro.covariance_estimates(table(spark, points)).first()
    point = np.array(row["mu"])
    point[4] += 0.7 * ro.UNIT  # half of the lines
    one = spark.createDataFrame([("g", *map(round, point.tolist()), row["mu"], row["inverse"])], "grp string, " + ", ".join(f"{x} int" for x in ro.X) + ", mu array<double>, inverse array<double>")
    assert one.select(ro.distance()).first()[0] > ro.chi_square_quantile(ro.REJECT, ro.P)


def test_steps_go_on_until_no_determinant_falls(spark):
    """From a start far out on a long ridge, where the subset moves a little in each step."""
    r = np.random.default_rng(6)
    points = r.normal(size=(2000, ro.P)) * 0.05
    points[:, 0] = r.exponential(4, 2000)
    vectors = table(spark, points)
    mu, inverse, logdet = ro._packed(np.array([30.0 * ro.UNIT] + [0.0] * (ro.P - 1)), np.diag(ro.FLOORS))
    start = spark.createDataFrame([("g", 0, 2000, mu, inverse, logdet)], ro.ESTIMATE)
    start = ro.stored(ro.concentrate(vectors, start), "start")
    last = ro.converged(vectors, start, ro.SUBSET)
    assert ro.concentrate(vectors, last).first()["logdet"] >= last.first()["logdet"] - 1e-9


def test_rows_of_small_tables_are_judged_too(spark, prose):
    rows = [(i, " ".join(prose(100, i)) + ".", "en", "s") for i in range(40)] + [(99, " ".join(w + "#$%" for w in prose(60, 5)), "en", "s")]
    rows = [(*r, "x", 7.5, True) for r in rows]
    schema = "doc_id bigint, text string, lang string, source string, grp string, distance double, base_failed boolean"
    found = {r["doc_id"]: r for r in ro.outlier_report(spark.createDataFrame(rows, schema)).collect()}
    assert not found[99]["base_failed"] and not found[99]["kept"] and found[99]["distance"] > 100
    assert sum(found[i]["kept"] for i in range(40)) >= 39
    one = ro.outlier_report(spark.createDataFrame(rows[:1], schema)).collect()
    assert one[0]["kept"] and one[0]["distance"] == 0


def test_equals_the_least_determinant_of_all_subsets(spark):
    """Twelve rows, three of them far out: every subset of nine is tried."""
    import itertools

    for seed in range(4):
        r = np.random.default_rng(seed)
        points = r.normal(size=(12, ro.P)) * 0.3
        points[9:] += r.normal(size=(3, ro.P)) * 6
        rounded = np.round(points * ro.UNIT).astype(int)
        best = min(
            ro.estimate(9, part.sum(axis=0), np.array([(part[:, i] * part[:, j]).sum() for i, j in ro.PAIRS]), ro.consistency(0.75))[2]
            for part in (rounded[list(c)].astype(float) for c in itertools.combinations(range(12), 9)))
        vectors = spark.createDataFrame([("g", *map(int, row)) for row in rounded], "grp string, " + ", ".join(f"{x} int" for x in ro.X))
        now = ro.stored(ro.starts(vectors), "starts")
        for _ in range(2):
            now = ro.stored(ro.concentrate(vectors, now), "concentrated")
        last = min(row["logdet"] for row in ro.converged(vectors, now.orderBy("logdet").limit(1)).collect())
        assert abs(last - best) < 1e-6
