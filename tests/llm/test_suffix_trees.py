import hashlib
import random

import numpy as np
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import suffix_trees as st


def brute(rows):
    key = lambda doc: st.LAST if doc is None else doc
    texts = [(key(doc), (t or "").encode().split()) for doc, t in rows]
    first = {}
    for doc, words in texts:
        for i in range(len(words) - st.WINDOW + 1):
            run = tuple(words[i:i + st.WINDOW])
            first[run] = min(first.get(run, doc), doc)
    out = []
    for (doc, words), (given, _) in zip(texts, rows):
        gone = set()
        for i in range(len(words) - st.WINDOW + 1):
            if first[tuple(words[i:i + st.WINDOW])] < doc:
                gone.update(range(i, i + st.WINDOW))
        left = [w for i, w in enumerate(words) if i not in gone]
        out.append((given, len(words), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def same(found, rows):
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found), key=order) == sorted(brute(rows), key=order)


def passages(prose, seed):
    r = random.Random(seed)
    shared = [prose(n, 50 + n) for n in (49, 50, 51, 75, 130, 400)]
    rows = []
    for k in range(40):
        words = prose(r.randint(0, 120), 1000 * seed + k)
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(shared)
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[r.randrange(40)][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("group", [st.GROUP, 40, 1])
def test_equals_all_windows(docs, prose, group):
    rows = passages(prose, 3)
    same(st.cut_texts(docs(rows), group).collect(), rows)


def test_edge_cases(docs, prose):
    a, b = " ".join(prose(60, 1)), " ".join(prose(50, 2))
    loop = " ".join(["la"] * 200)
    rows = [(1, None), (2, ""), (3, a), (3, a), (3, a + " " + b), (4, b), (None, b), (None, a), (5, loop), (6, loop + " end"),
            (7, " ".join(prose(49, 3))), (8, " ".join(prose(49, 3))), (9, "\n" + a.replace(" ", "\t\x0b")), (10, " ".join(prose(30_000, 8, 9000)) + " " + a)]
    same(st.cut_texts(docs(rows)).collect(), rows)


def test_empty_table(spark):
    assert st.cut_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_anchors_are_the_least_grams(prose):
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 130, dtype=np.uint64)
    grams = st.run_hashes(hashes, st.ANCHOR)
    width = st.WINDOW - st.ANCHOR + 1
    expected = [int(grams[i:i + width].min()) for i in range(130 - st.WINDOW + 1)]
    assert st.anchors(hashes).view(np.uint64).tolist() == expected


def test_deep_leaves():
    r = np.random.default_rng(2)
    suffixes = r.integers(0, 2, (60, st.WINDOW), dtype=np.uint64)
    suffixes[:, :-1] = 1  # they differ in the last word only
    groups, ids = r.integers(0, 3, 60), r.integers(0, 20, 60)
    marked = st.deep_leaves(groups, ids, suffixes)
    for k in range(60):
        mates = [ids[j] for j in range(60) if groups[j] == groups[k] and (suffixes[j] == suffixes[k]).all()]
        assert marked[k] == (min(mates) < ids[k])
