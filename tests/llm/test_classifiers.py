import math
import random

import numpy as np
import pytest
from helpers_llm import docs, prose  # noqa: F401

from vigilog.llm import kneser_ney as kn
from vigilog.llm import labelled
from vigilog.llm import subword_classifier as sc
from vigilog.llm.common import fold

TOXIC = ["idiot", "moronic", "scumbag", "worthless"]


def corpus(prose, n=400):
    """Texts and labels (text, toxic, quality): insults scattered in a fifth, junk in another."""
    r = random.Random(3)
    out = []
    for k in range(n):
        words, toxic, quality = prose(r.randint(15, 90), 100 + k, 300), 0, 1
        if k % 5 == 0:
            toxic = 1
            for _ in range(max(2, len(words) // 15)):
                words[r.randrange(len(words))] = r.choice(TOXIC)
        if k % 5 == 1:
            quality = 0
            words = [words[0]] * len(words) if k % 2 else [w + "!!" for w in words]
        out.append((" ".join(words), toxic, quality))
    return out


def tables(spark, docs, prose, extra=()):
    rows = corpus(prose)
    frame = docs([(i, t) for i, (t, _, _) in enumerate(rows)] + list(extra))
    return rows, frame, spark.createDataFrame([(i, t, q) for i, (_, t, q) in enumerate(rows)], "doc_id bigint, toxic int, quality int")


EDGE = [(1000, None), (1001, ""), (None, "a b c"), (1002, "word " * 50_000), (1003, "x"), (1003, "x"), (1004, "\x0b\n")]


@pytest.mark.parametrize("report, label, cut", [(kn.toxicity_report, "toxic", 0.5), (sc.quality_report, "quality", 0.3)])
def test_held_out_accuracy_and_edges(spark, docs, prose, report, label, cut):
    rows, frame, labels = tables(spark, docs, prose, EDGE)
    found = report(frame, labels).collect()
    assert len(found) == len(rows) + len(EDGE)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    truth = {i: (t, q)[label == "quality"] for i, (_, t, q) in enumerate(rows)}
    held = [(r["predicted"], truth[i]) for i, r in by_id.items() if i in truth and r["held_out"]]
    assert len(held) > 40
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert by_id[None]["held_out"] is True
    assert by_id[1000]["score"] == by_id[1001]["score"]


@pytest.mark.parametrize("report, label, score", [(kn.toxicity_report, "toxic", 0.0), (sc.quality_report, "quality", 0.5)])
def test_without_labels_of_both_classes(spark, docs, report, label, score):
    frame = docs([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1), (2, None)], f"doc_id bigint, {label} int")
    assert {r["score"] for r in report(frame, labels).collect()} == {score}
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert report(none, labels).collect() == []


def test_sample_is_bounded_and_never_held_out(spark, docs):
    frame = docs([(i, f"t {i}") for i in range(300)] + [(5, "again"), (6, "z" * 300_000), (None, "n")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0), (8, None), (None, 1)], "doc_id bigint, y int")
    rows = labelled.sample(frame, labels, "y", {0: 40, 1: 30}).collect()
    assert [sum(r["label"] == y for r in rows) for y in (0, 1)] == [40, 30]
    folds = {r["doc_id"]: r["f"] for r in spark.range(300).withColumnRenamed("id", "doc_id").withColumn("f", fold("doc_id", 5)).collect()}
    assert all(folds[r["doc_id"]] != 0 for r in rows)
    every = labelled.sample(frame, labels, "y", {0: 1000, 1: 1000}).collect()
    assert 7 not in {r["doc_id"] for r in every}  # its labels contradict each other
    assert sum(folds[r["doc_id"]] != 0 for r in every) == len({r["doc_id"] for r in every}) == len(every)


def test_lower_orders_sum_to_one():
    words = ["abc", "abd", "bcd", "aab", "dd"]
    shared = kn.Shared({g for w in words for g in kn.grams(w)})
    letters = {g[-1] for w in words for g in kn.grams(w)}
    for before in ("", "a", "ab", "zz"):
        assert math.isclose(sum(shared.probability(before + x) for x in letters), 1.0, rel_tol=1e-9)


def test_unseen_expressions_are_neutral_and_stems_are_not():
    from collections import Counter

    r = random.Random(1)
    plain = Counter("".join(r.choice("abcdehilmnorst") for _ in range(6)) for _ in range(4000))
    toxic = plain + Counter({f"zzgrb{e}": 12 for e in ("an", "ee", "or", "it")})
    ratio = kn.Ratio.fitted({1: toxic, 0: plain})
    assert ratio.word("zzgrbul") > 4  # a new ending of a stem
    assert abs(ratio.word("yyyyyy")) < 1  # nobody has seen it


def test_word_shares_add_up_to_the_average():
    """A document's score is the softmax of its features' average vector."""
    rows = np.random.default_rng(1).normal(size=sc.BUCKETS)
    model = sc.Embeddings(rows, 0.3)
    words = [b"one", b"two", b"two", b"\xc3\xa9t\xc3\xa9"]
    ids = [i for w in words for i in sc.features(w)] + [sc.zlib.crc32(sc.AGAIN) % sc.BUCKETS]
    expected = 1 / (1 + math.exp(-(rows[ids].mean() + 0.3)))
    assert math.isclose(sc.score(model, sc.WordShares(rows), b" ".join(words))[1], expected, rel_tol=1e-9)


def test_long_texts_reach_the_trainer_in_pieces(spark, prose):
    texts = {1: " ".join(prose(3000, 1)), 2: "", 3: "x" * 250, 4: "a b\n" * 90, 5: "é " * 100}
    rows = spark.createDataFrame([(i, 100 - i, i % 2, t) for i, t in texts.items()], "doc_id bigint, rank bigint, label int, text string")
    found = labelled.in_pieces(rows, 60).collect()
    assert [r["rank"] for r in found] == sorted(r["rank"] for r in found)
    for i, text in texts.items():
        own = [r["text"] for r in found if r["doc_id"] == i]
        assert "".join(own) == text and all(len(p) <= 60 for p in own)
        if i != 3:  # no word is cut
            assert [w for p in own for w in p.split()] == text.split()
    known = {}
    assert sc.counted([b"a b b", b"b c"], known) == sc.counted([b"a b b b c"], known)


def test_gradients_equal_differences():
    r = np.random.default_rng(2)
    rows, weights, layer, shift = r.normal(size=(5, 3)), r.random(5), r.normal(size=(2, 3)), r.normal(size=2)

    def value():
        z = layer @ (weights @ rows) + shift
        return z[1] - np.log(np.exp(z).sum())

    for array, found in zip((layer, shift, rows), sc.gradients(rows, weights, layer, shift, 1)):
        for place in np.ndindex(array.shape):
            array[place] += 1e-6
            high = value()
            array[place] -= 2e-6
            low = value()
            array[place] += 1e-6
            assert abs((high - low) / 2e-6 - found[place]) < 1e-6


def test_training_tells_two_kinds_apart():
    model = sc.fit([(k, k % 2, {3: 2, 5: 1} if k % 2 else {5: 3}) for k in range(80)] + [(99, 1, {})])
    value = lambda counts: sum(model.rows[i] * n for i, n in counts.items()) / sum(counts.values()) + model.shift
    assert value({3: 2, 5: 1}) > 0 > value({5: 3})


def test_no_session_setting_is_changed(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    kn.toxicity_report(docs([(1, "a b")]), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).collect()
    assert spark.conf.get(name) == before
