import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import periodic_runs as pr


def brute(words):
    """All runs as (start, length, period), by trying every period."""
    n, found = len(words), []
    for q in range(1, n // pr.EXPONENT + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(pr.LEAST, pr.EXPONENT * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    smallest = lambda r: not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in found)
    return sorted((r for r in found if smallest(r)), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def periodic_text(r, kinds):
    words = [str(r.randrange(kinds)) for _ in range(r.choice([0, 3, 40, 90]))]
    for _ in range(r.randint(0, 3)):
        period = [str(r.randrange(kinds)) for _ in range(r.randint(1, 12))]
        at = r.randint(0, len(words))
        words[at:at] = (period * 9)[:r.randint(len(period), 8 * len(period))]
    return " ".join(words)


@pytest.mark.parametrize("batch", [1, 50, pr.WORDS])
def test_equals_all_periods(docs, batch):
    r = random.Random(5)
    rows = [(i, periodic_text(r, r.choice([1, 2, 3, 50]))) for i in range(150)]
    found = {x["doc_id"]: x for x in pr.periodic_runs(docs(rows), batch).collect()}
    for i, text in rows:
        words = text.encode().split()
        expected = brute(words)
        assert [tuple(x) for x in found[i]["runs"]] == expected
        assert found[i]["collapsed"] == collapsed(words, expected) and found[i]["n_words"] == len(words)


def test_edge_cases(docs, prose):
    long = " ".join(prose(400_000, 3, 5000)) + " la" * 9
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y " * 4), (6, "x y x y x y x"), (7, "é ü " * 5),
            (8, "a\x0ba\x0ca\ra\ta\na"), (9, "a b " * 6), (10, long)]
    found = sorted(((x["doc_id"] or 0, [tuple(y) for y in x["runs"]], x["collapsed"]) for x in pr.periodic_runs(docs(rows)).collect()), key=lambda x: x[0])
    short = [x for x in found if x[0] != 10]
    assert short == [(0, [(0, 8, 2)], "x y"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"),
                     (6, [], "x y x y x y x"), (7, [(0, 10, 2)], "é ü"), (8, [(0, 6, 1)], "a"), (9, [(0, 6, 1)], "a b")]
    assert found[-1][1][-1] == (400_000, 9, 1) and found[-1][2].endswith(" la")


def test_empty_table(spark):
    assert pr.run_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_one_long_period_and_one_word_repeated(docs, prose):
    period = prose(3000, 4, 2000)
    rows = [(1, " ".join(period * 5)), (2, "na " * 60_000)]
    found = {x["doc_id"]: [tuple(y) for y in x["runs"]] for x in pr.periodic_runs(docs(rows)).collect()}
    assert found == {1: [(0, 15_000, 3000)], 2: [(0, 60_000, 1)]}


def test_wavelet_tree():
    r = np.random.default_rng(3)
    values = r.permutation(200)
    tree = pr.WaveletTree(values)
    begin = r.integers(0, 200, 500)
    end = np.minimum(begin + r.integers(0, 60, 500), 200)
    after = r.integers(0, 260, 500)
    found, following = tree.successors(begin, end, after)
    expected = [min((v for v in values[b:e] if v > a), default=None) for b, e, a in zip(begin, end, after)]
    assert dict(zip(found.tolist(), following.tolist())) == {i: v for i, v in enumerate(expected) if v is not None}


def test_report_by_hand(docs, prose):
    rows = [(i, " ".join(prose(i % 70, i, 30))) for i in range(200)] + [(777, None)]
    found = {x["doc_id"]: x for x in pr.run_report(pr.with_planted_runs(docs(rows))).collect()}
    planted = 0
    for i, text in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        runs = brute(words)
        planted += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        x = found[i]
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5
