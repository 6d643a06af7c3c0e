import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import common as py_common
from vigilog.llm import pitman_yor as py


def learned(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 != 0


def tokens(text):
    return (text or "").encode().lower().split() + [py.END]


def check(found, rows):
    counts = Counter(t for doc, text in rows if learned(doc) for t in tokens(text))
    total, types = sum(counts.values()), len(counts)
    wanted = sorted(
        (str(doc), not learned(doc), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), total,
         round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in tokens(text)), 5))
        for doc, text in rows
    )
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-6, atol=1e-4)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


@pytest.mark.parametrize("block", [py.BLOCK, 300])
def test_counts_and_base(docs, prose, block):
    rows = [(i, " ".join(prose(10 + i % 50, i)).title()) for i in range(60)]
    found = py.scores(docs(rows), block).collect()
    check(found, rows)


def test_blocks_change_nothing(docs, prose):
    rows = [(i, " ".join(prose(30, i))) for i in range(40)]
    one = {r["doc_id"]: r["score"] for r in py.scores(docs(rows, 1)).collect()}
    many = {r["doc_id"]: r["score"] for r in py.scores(docs(rows, 5), 100).collect()}
    assert all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_edge_cases(docs, prose):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a b"), (4, " ".join(prose(30_000, 2, 5000))), (5, "\x0b"), (6, "A a É é")]
    check(py.scores(docs(rows)).collect(), rows)
    check(py.scores(docs([(None, "only held out")])).collect(), [(None, "only held out")])


def test_empty_table(spark):
    assert py.scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_better_than_the_base_on_unseen_texts(docs, prose):
    rows = [(i, " ".join(x for w in prose(40, i, 60) for x in (w, w + "x"))) for i in range(300)]
    held = [r for r in py.scores(docs(rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_seating_follows_the_process():
    """Average tables against a plain simulation of the Chinese restaurant process."""
    random = np.random.default_rng(1)
    for n, opening, discount in ((2, 0.4, 0.5), (30, 1.5, 0.3), (500, 2.0, 0.6)):
        runs = 4000
        found = py.seat(np.full(runs, n), np.full(runs, opening), discount, np.arange(runs, dtype=np.uint64), 3)
        plain = []
        for _ in range(400):
            t = 1
            for i in range(1, n):
                t += random.random() < opening / (opening + i - discount * t)
            plain.append(t)
        assert abs(found.mean() - np.mean(plain)) < 0.15 + 0.03 * np.mean(plain)
        assert found.min() >= 1 and found.max() <= n


def test_predictive_probabilities_sum_to_one(spark):
    cells = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (1, 0, 300), (3, 3, 2)], "context int, dish int, n bigint")
    matrix = py.context_sweeps(cells, 4)
    assert np.allclose(matrix.sum(axis=1), 1, atol=1e-5)
    assert matrix[1].argmax() == 0
    classes = py.Classes([5, -7])
    words = np.arange(1000, 1400, dtype=np.int64)
    counts = np.arange(400) % 9 + 1
    frame = spark.createDataFrame([(int(w), int(c)) for w, c in zip(words, counts)], "word bigint, c bigint")
    rooms = py.rare_sweeps(frame, classes)
    p, kind = rooms.probability(words, counts), classes.of(words)
    others = np.arange(10_000, 14_000, dtype=np.int64)
    unknown = rooms.probability(others, np.zeros(4000, np.int64))
    assert (unknown > 0).all()
    for k in np.unique(kind):
        new = unknown[classes.of(others) == k]
        assert math.isclose(p[kind == k].sum() + new[0], 1, rel_tol=1e-9)  # the words seen and one that stands for all others
    assert rooms.probability(np.array([5], np.int64), np.array([9]))[0] == 1.0


def test_rare_words_are_contexts_of_their_own(docs):
    """Words that come some times each and are always followed by the same one: only their own pairs tell what follows."""
    random = np.random.default_rng(5)
    rows = []
    for doc in range(600):
        word, text = int(random.integers(4000)), []
        for _ in range(40):
            text.append(f"w{word}")
            word = (word * 7 + 1) % 4000
        rows.append((doc, " ".join(text)))
    held = [r for r in py.scores(docs(rows), 5000).collect() if r["held_out"]]
    assert -sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) * math.log(10) < 2.5


@pytest.mark.parametrize("buckets", [1, 7])
def test_every_pair_is_counted_and_each_context_sums_to_one(spark, docs, prose, buckets):
    rows = [(i, " ".join(prose(40, i, 30))) for i in range(50)]
    blocks = py.stored(py.encoded(docs(rows), 300), "blocks")
    hashes = {t: int(np.array([py.WordHash()[t]], np.uint64).view(np.int64)[0]) for _, text in rows for t in tokens(text)}
    wanted, of = Counter(), Counter()
    for doc, text in rows:
        if learned(doc):
            words = tokens(text)
            wanted.update((hashes[a], hashes[b]) for a, b in zip([py.END, *words], words))
            of.update(hashes[t] for t in words)
    frequent = [hashes[py.END], *sorted(of)[:3]]
    classes = py.Classes(frequent)
    customers = np.zeros(len(classes))
    customers[classes.of(np.array(frequent, np.int64))] = [of[w] for w in frequent]
    merged = py.stored(py.merged_pairs(blocks, classes, buckets), "merged")
    found = Counter()
    for r in merged.collect():
        found.update(dict(zip(zip(py.unpack(r["contexts"], np.int64).tolist(), py.unpack(r["words"], np.int64).tolist()), py.unpack(r["n"], np.int64).tolist())))
    assert found == wanted

    cells = py.stored(py.class_cells(merged, classes), "cells")
    rare = py.stored(py.rare_customers(merged), "rare")
    tables = np.zeros(len(classes))
    for r in cells.groupBy("context").agg({"n": "sum"}).collect():
        tables[r[0]] = r[1]
    following = spark.sparkContext.broadcast(np.log10(py.context_sweeps(cells, len(classes))))
    state = py.stored(py.with_parents(merged, classes, following, py.rare_sweeps(rare, classes), rare), "parents")
    seated, left = py.word_sweeps(state, classes, customers, tables)
    sums, share = Counter(), {}
    packed = {r["bucket"]: r for r in merged.collect()}
    for r in seated.collect():
        contexts = py.unpack(packed[r["bucket"]]["contexts"], np.int64)
        for u, own, rest in zip(contexts.tolist(), py.unpack(r["own"], np.float32).tolist(), py.unpack(r["share"], np.float32).tolist()):
            sums[u] += own
            assert abs(share.setdefault(u, rest) - rest) < 1e-6
    assert all(abs(sums[u] + share[u] - 1) < 1e-4 for u in of)
    assert all(abs(left[classes.of(np.array([u], np.int64))[0]] - share[u]) < 1e-5 for u in frequent)


def test_every_customer_is_a_draw():
    """Mean and variance of the tables of many customers, with a weight that grows with the tables, against a plain simulation."""
    random = np.random.default_rng(2)
    n, opening, discount, growth = 1500, 2.0, 0.5, 0.1
    found = py.seat(np.full(4000, n), np.full(4000, opening), discount, np.arange(4000, dtype=np.uint64), 1, growth)
    t = np.ones(4000)
    for i in range(1, n):
        weight = opening + growth * t
        t += random.random(4000) < weight / (weight + i - discount * t)
    assert abs(found.mean() / t.mean() - 1) < 0.03
    assert abs(found.var() / t.var() - 1) < 0.15
    fixed = py.seat(np.full(4000, n), np.full(4000, opening), discount, np.arange(4000, dtype=np.uint64), 1)
    t = np.ones(4000)
    for i in range(1, n):
        t += random.random(4000) < opening / (opening + i - discount * t)
    assert abs(fixed.var() / t.var() - 1) < 0.15


def test_numbers_are_packed_without_loss():
    random = np.random.default_rng(4)
    hashes = random.integers(-(1 << 63), (1 << 63) - 1, 50)
    for x in (np.empty(0, np.int64), hashes, np.sort(hashes), hashes[random.integers(0, 50, 3000)], np.array([-(1 << 63), (1 << 63) - 1, 0]), np.arange(5, dtype=np.int32), random.random(70).astype(np.float32)):
        for way in (py.PLANES, py.RUNS, *[py.STEPS, py.DISTINCT] * (x.dtype.kind == "i")):
            back = py.unpack(py.pack(x, way), x.dtype)
            assert back.dtype == x.dtype and (back == x).all()
    many = hashes[np.sort(random.integers(0, 50, 3000))]
    assert len(py.pack(many, py.DISTINCT)) < 800


def test_disk_is_not_left_taken(spark, docs, prose, tmp_path, monkeypatch):
    """What the steps store goes when it is read: only what the result reads stays in the shared folder."""
    rows = [(i, " ".join(prose(40, i))) for i in range(40)]
    names = iter(range(1000))
    monkeypatch.setattr(py_common, "shared_path", lambda spark, name: f"{tmp_path}/{name}-{next(names)}")
    found = py.scores(docs(rows))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["blocks", "known", "replies"]
    check(found.collect(), rows)
    assert spark.conf.get(py_common.CLEANUP, "false") == "false"


def test_words_are_split_at_the_six_spaces_only():
    random = np.random.default_rng(6)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\0", "a", "B", "\xc9", "\u00df", "Z\u0130"]
    texts = ["".join(random.choice(parts, random.integers(0, 12))) for _ in range(2000)] + [None, "", " ", "a ", " a"]
    for kind in (pa.string(), pa.large_string()):
        words, sizes = py.split_words(pa.array(texts, kind))
        wanted = [(x or "").encode().lower().split() for x in texts]
        assert sizes.tolist() == [len(w) for w in wanted]
        assert [w.encode() for w in words.to_pylist()] == [w for each in wanted for w in each]


class Frame:
    """Batches in place of a table, for the functions of a step without Spark."""

    sparkSession = None

    def __init__(self, batches):
        self.batches = batches

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return Frame(list(run(iter(self.batches))))

    def groupBy(self, name):
        return self

    def agg(self, *sums):
        return self

    def collect(self):
        rows = [x for b in self.batches for x in zip(b["kind"].to_pylist(), b["n"].to_pylist())]
        return [(kind, sum(n for k, n in rows if k == kind)) for kind in {k for k, _ in rows}]


def test_sweep_seats_frequent_contexts_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = np.sort(r.integers(-(2**62), 2**62, 50))
    classes = py.Classes(list(words[::2]))
    context, word = (x.reshape(-1) for x in np.meshgrid(np.arange(50), np.arange(50), indexing="ij"))
    n = r.integers(1, 30, 2500)
    row = (py.pack_distinct(words, context), py.pack_distinct(words, word), py.pack(n), py.pack(np.full((n > 1).sum(), 0.02, np.float32)))
    state = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["bucket", "contexts", "words", "n", "parent"])
    customers, tables = (np.bincount(classes.of(words)[context], x, minlength=len(classes)) for x in (n, np.ones(2500)))

    seated, seat = [], py.seat
    monkeypatch.setattr(py, "stored", lambda frame, name: frame)
    monkeypatch.setattr(py, "dropped", lambda *frames: None)
    monkeypatch.setattr(py, "seat", lambda counts, *rest: seated.append(len(counts)) or seat(counts, *rest))
    found, left = py.word_sweeps(Frame([state]), classes, customers, tables)
    pairs = int(((n > 1) & (context % 2 == 0)).sum())
    assert seated == [pairs] * py.SWEEPS + [int((n > 1).sum())] * py.SWEEPS  # the last ones for all pairs

    monkeypatch.setattr(py, "seat", seat)
    part, discount, strength, history = py.Bucket(classes, *row), *py.WORDS, [tables]
    for _ in range(py.SWEEPS):  # the same sweeps, each from the start
        opened = np.ones(2500, np.int64)
        for sweep, before in enumerate(history):
            opened = part.seated(part.summed(opened, before), opened, sweep)
        history.append(np.bincount(part.kind, opened * part.frequent, minlength=len(classes)))
    assert np.allclose(left, np.mean([(strength + discount * t) / (strength + customers) for t in history[py.BURN_IN + 1:]], axis=0))
    kind = classes.of(words)
    of = py.unpack(found.batches[0]["cells"][0].as_py(), np.int64), py.unpack(found.batches[0]["cell_tables"][0].as_py(), np.int64)
    cells = np.bincount(kind[context] * len(classes) + kind[word], opened, minlength=len(classes) ** 2)
    assert (cells[of[0]] == of[1]).all() and cells.sum() == of[1].sum()


@pytest.mark.parametrize("size, tokens", [(1, 1), (5, 40), (300, 5000), (2**22 + 2, 2**18 + 1)])  # the last one is too large for one number
def test_block_pairs(size, tokens):
    r = np.random.default_rng(size)
    vocabulary = np.unique(r.integers(-(2**62), 2**62, size))
    r.shuffle(vocabulary)
    at = r.integers(0, min(len(vocabulary), 300), tokens).astype(np.int32)
    classes = py.Classes(list(vocabulary[:3]))
    context, word, bucket, of = py.block_pairs(py.pack(at), vocabulary, classes, 70)
    assert (word[of] == at).all() and (context[of] == np.roll(at, 1)).all()
    assert len(context) == len(set(zip(np.roll(at, 1).tolist(), at.tolist())))
    order = list(zip(bucket.tolist(), vocabulary[context].tolist(), vocabulary[word].tolist()))
    assert order == sorted(order)


@pytest.mark.parametrize("kind", [np.int32, np.int64, np.float32])
@pytest.mark.parametrize("values", [[], [0], [0, 0, 1], [3, 200, 70_000, 2], [-1, 5, 2**31 - 1]])
def test_packed_numbers_come_back(kind, values):
    x = np.array(values, kind)
    for way in (py.PLANES, py.RUNS) if kind is np.float32 else (py.PLANES, py.STEPS, py.DISTINCT, py.RUNS):
        assert py.unpack(py.pack(x, way), kind).tolist() == x.tolist()
