import random
from collections import defaultdict

import numpy as np
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import common, hamming_join as hj
from vigilog.llm.components import components
from vigilog.llm.containment import shingles


def brute(rows, size):
    """Component of each row by all pairs."""
    sets = [set(shingles((t or "").encode().lower().split(), size)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in least[find(i)] if d is not None]
        component = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def copies(prose, seed):
    """Originals, their edited copies in chains, and texts that share half."""
    r = random.Random(seed)
    rows, number = [], 0
    for k in range(12):
        words = prose(r.choice([3, 12, 60, 200]), 100 * seed + k)
        for _ in range(r.randint(1, 9)):
            rows.append((number, " ".join(words)))
            number += 1
            words = list(words)
            for _ in range(max(1, len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(["edit", "swap", "New"])
    return rows


def test_many_copies_that_are_not_linked(docs, prose):
    """Edited copies of one text: most pairs stay a little under the threshold, some chains pass it."""
    r = random.Random(9)
    base, rows = prose(150, 77), []
    for k in range(90):
        words = rows[-1][1].split() if rows and k % 3 == 0 else list(base)
        for at in r.sample(range(len(words)), r.choice([3, 12, 13, 14, 20])):
            words[at] = f"{words[at]}{k}x{at}"
        rows.append((k, " ".join(words)))
    frame = docs(rows)
    found = [tuple(x) for x in hj.near_duplicates(frame, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    expected = brute(rows, 2)
    assert 5 < len({x[2] for x in expected}) < 85
    assert sorted(found) == sorted(expected)


def test_copies_beside_a_large_group_make_no_pairs(docs, prose, monkeypatch):
    """Copies with too many changes to be linked are not listed with every member of the group they stem from."""
    r, made = random.Random(3), []
    base, rows = prose(150, 78, 4000), []
    for k in range(90):
        words = list(base)
        for at in r.sample(range(len(words)), 8 if k % 3 == 0 else 3):
            words[at] = f"{words[at]}{k}x{at}"
        rows.append((k, " ".join(words)))
    listed = hj.pairs_left

    def counted(sets):
        pairs = listed(sets)
        made.append((sets.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(hj, "pairs_left", counted)
    found = [tuple(x) for x in hj.near_duplicates(docs(rows), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(found) == sorted(brute(rows, 2))
    assert made[0][0] > 80 and made[0][1] < 90


def test_sketches_differ_in_no_more_places_than_sets():
    r = random.Random(6)
    for n in (1, 40, 150, 5000):
        one = [r.randrange(1 << 64) for _ in range(n)]
        other = one[: n - n // 9] + [r.randrange(1 << 64) for _ in range(n // 9)]
        a, b = (hj.parity_sketch(np.unique(np.array(x, np.uint64))) for x in (one, other))
        apart = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        assert len(a) == hj.SKETCH and apart <= len(set(one) ^ set(other))
        assert n != 150 or apart > 25


@pytest.mark.parametrize("size, seed", [(2, 1), (2, 2), (5, 3)])
def test_equals_all_pairs(docs, prose, size, seed):
    rows = copies(prose, seed)
    found = [tuple(r) for r in hj.near_duplicates(docs(rows), size).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(found) == sorted(brute(rows, size))


def test_edge_cases(docs, prose):
    long = " ".join(prose(40_000, 5, 5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "One\x0btwo"), (7, "one two"), (None, "one two"), (None, "alone here now"),
            (8, long), (9, long + " more"), (7, "one two"), (7, "else where is it")]
    found = [tuple(r) for r in hj.near_duplicates(docs(rows), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(brute(rows, 2), key=key)


def test_empty_table(docs, spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert hj.near_duplicates(empty, 2).collect() == []


def test_pigeonhole():
    """Signatures that differ in at most 27 places always share a key."""
    r = random.Random(4)
    most = hj.CHUNKS * (hj.ERRORS + 1) - 1
    keys = lambda s: {(c, d, s[c * hj.WIDTH:(c + 1) * hj.WIDTH][:d] + s[c * hj.WIDTH:(c + 1) * hj.WIDTH][d + 1:]) for c in range(hj.CHUNKS) for d in range(hj.WIDTH)}
    for _ in range(200):
        one = bytes(r.randrange(256) for _ in range(hj.SYMBOLS))
        other = bytearray(one)
        for at in r.sample(range(hj.SYMBOLS), most):
            other[at] ^= r.randrange(1, 256)
        assert keys(one) & keys(bytes(other))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1000, 1001)], "a int, b int").repartition(5)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_one_of_each_keeps_columns(docs):
    frame = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other text"), (None, "a b c d e f g"), (4, None)])
    left = hj.one_of_each(frame, 5)
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


@pytest.mark.parametrize("links,tables", [([], 1), ([(1, 0), (0, 2)], 2), ([(1, 1)], 1)])
def test_components_do_no_round_more_than_needed(spark, tmp_path, monkeypatch, links, tables):
    names = iter(range(100))
    monkeypatch.setattr(common, "shared_path", lambda spark, name: f"{tmp_path}/{name}-{next(names)}")
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: 0 for pair in links for x in pair if pair[0] != pair[1]}
    assert next(names) == tables
