import random

import numpy as np
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import containment as ct


def brute(rows, items):
    out = []
    for item, text in items:
        wanted = set(ct.shingles((text or "").encode().lower().split()))
        for doc, whole in rows:
            shared = len(wanted & set(ct.shingles((whole or "").encode().lower().split())))
            if wanted and 100 * shared >= 80 * len(wanted):
                out.append((doc, item, len(wanted), shared))
    return sorted(out, key=str)


def items_of(spark, items):
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    return frame.repartition(2)


def hidden(prose, seed):
    """Items of 1 to 300 words inside documents of up to 20,000, whole, in parts, scattered or with a few words changed."""
    r = random.Random(seed)
    items = [(k, prose(n, 10 * seed + k)) for k, n in enumerate((1, 3, 5, 6, 9, 20, 33, 64, 65, 150, 300))]
    rows = []
    for k in range(60):
        words = prose(r.choice([5, 60, 900, 20_000]) if k % 10 == 0 else r.randint(5, 300), 5000 + 100 * seed + k, 3000)
        item = list(r.choice(items)[1])
        if r.random() < 0.5 and len(item) > 8:
            item[r.randrange(len(item))] = "Changed"
        if r.random() < 0.3:
            item = item[: max(1, int(len(item) * r.uniform(0.7, 1)))]
        cuts = sorted(r.sample(range(len(item) + 1), min(2, len(item)))) if r.random() < 0.3 else []
        for a, b in zip([0, *cuts], [*cuts, len(item)]):
            at = r.randint(0, len(words))
            words[at:at] = item[a:b]
        rows.append((k, " ".join(words).title() if k % 3 else " ".join(words)))
    return rows, [(k, "\n".join(w)) for k, w in items]


@pytest.mark.parametrize("seed, block", [(1, ct.BLOCK), (2, 4)])
def test_equals_all_pairs(spark, docs, prose, seed, block):
    rows, items = hidden(prose, seed)
    found = [tuple(r) for r in ct.contained_items(docs(rows), items_of(spark, items), block).collect()]
    assert sorted(found, key=str) == brute(rows, items)


def test_edge_cases(spark, docs, prose):
    text = " ".join(prose(30, 1))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (None, "x " + text), (5, "one"), (6, "one two"), (7, " ".join(prose(200_000, 3, 9000)) + " " + text)]
    items = [(1, None), (2, ""), (3, text), (3, text), (None, "One"), (4, "one two three")]
    found = [tuple(r) for r in ct.contained_items(docs(rows), items_of(spark, items)).collect()]
    assert sorted(found, key=str) == brute(rows, items)
    left = ct.clean_documents(docs(rows), items_of(spark, items))
    assert left.columns == docs(rows).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 2, 3, 6]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert ct.contained_items(none, items_of(spark, [(1, "a b")])).collect() == []
    assert ct.contained_items(docs([(1, "a b")]), no_items).collect() == []
    assert ct.clean_documents(docs([(1, "a b")]), no_items).count() == 1


def test_recall_at_the_threshold():
    """Pairs of containment 0.8, item sizes at both ends of a class, in a long document: all are candidates."""
    r = np.random.default_rng(5)
    for size in (4, 15, 16, 63, 64):
        k = ct.size_class(size)
        missed = 0
        for _ in range(150):
            item = r.integers(0, 1 << 32, size, dtype=np.uint32)
            doc = r.integers(0, 1 << 32, 3000, dtype=np.uint32)
            kept = item[: -(-size * 4 // 5)]
            at = r.integers(0, 3000 - len(kept))
            doc[at:at + len(kept)] = kept
            index = ct.ItemIndex([])
            index.ids, index.sets = [0], [frozenset(range(size))]
            values = (item[:, None] * ct.MULTIPLIERS).min(axis=0)
            seen = [np.zeros(1 << 16, bool) for _ in range(ct.HASHES)]
            for s, v in zip(seen, values):
                s[v >> 16] = True
            index.classes[k] = [(s, values[j:j + 1], np.array([0])) for j, s in enumerate(seen)]
            missed += (0, 0) not in index.candidates(doc, np.array([0]), np.array([3000]))
        assert missed == 0


def test_one_index_at_a_time(spark, docs, prose, monkeypatch):
    """The result of a block of items is stored before the index of the next one is built."""
    steps = []
    index, stored = ct.ItemIndex, ct.stored
    monkeypatch.setattr(ct, "ItemIndex", lambda part: (steps.append("index"), index(part))[1])
    monkeypatch.setattr(ct, "stored", lambda df, name: (steps.append("stored"), stored(df, name))[1])
    texts = [(i, " ".join(prose(40, i))) for i in range(5)]
    items = spark.createDataFrame(texts, "item_id bigint, text string")
    found = ct.contained_items(docs(texts), items, block=2).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(5)}
    assert steps == ["index", "stored"] * 3
