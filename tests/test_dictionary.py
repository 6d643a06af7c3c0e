"""The block dictionary: front coding, look-ups that fetch few blocks, and encoding in place."""

import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import dictionary as di
from vigilog.operators import ranking, vocabulary
from vigilog.sources.tables import document_lines


@pytest.fixture
def folder(tmp_path):
    names = iter(range(1000))
    return lambda: str(tmp_path / f"dictionary{next(names)}")


def some_words(n, seed=1):
    r = random.Random(seed)
    return sorted({"".join(r.choice("abcé\U0001f600") for _ in range(r.randint(1, 12))) for _ in range(n)})


def test_front_coding_round_trip():
    words = sorted(w.encode() for w in some_words(500)) + [b"z" * 100_000, b"z" * 100_000 + b"a"]
    assert di.decoded(*di.front_coded(words)) == words
    assert di.decoded(*di.front_coded([b"one"])) == [b"one"]


@pytest.mark.parametrize("block_words", [9, 60, 10_000])
def test_numbers_of_words(spark, folder, block_words):
    words = some_words(800)
    rows = [(w, i) for i, w in enumerate(words)] + [(words[3], 99_999), (None, 5)]
    path = di.write_dictionary(spark.createDataFrame(rows, "word string, idx bigint").repartition(4), folder(), block_words)
    found = di.Dictionary(path)
    asked = [w.encode() for w in words[::3]] + [b"", b"not there", "zz\U0001f600\U0001f600".encode(), words[3].encode()]
    places = {w.encode(): i for i, w in enumerate(words)}
    assert found.numbers(asked, -1) == [places.get(w, -1) for w in asked]
    fetched = found.fetched
    assert fetched <= len(found.blocks) and found.numbers(asked, -7) == [places.get(w, -7) for w in asked]
    assert found.fetched == fetched  # all known by now, also those that are not there


def test_few_blocks_are_fetched(spark, folder):
    words = [f"w{i:06}" for i in range(20_000)]
    path = di.write_dictionary(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, idx bigint"), folder(), 100)
    found = di.Dictionary(path)
    assert len(found.blocks) >= 200
    assert found.numbers([b"w000001", b"w000050", b"w010000", b"x"], -1) == [1, 50, 10_000, -1]
    assert found.fetched <= 3


def test_memory_of_known_words_is_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(di, "KNOWN", 10)
    words = some_words(300)
    path = di.write_dictionary(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, idx bigint"), folder(), 50)
    found = di.Dictionary(path)
    for at in range(0, len(words), 5):
        part = [w.encode() for w in words[at:at + 5]]
        assert found.numbers(part, -1) == list(range(at, at + len(part)))
        assert len(found.known) <= 15


def test_encoding_moves_no_tokens(spark, lines):
    log = lines(["b a a", "c B d", "zzz " * 1000, "", None, "é"])
    words = vocabulary.vocabulary(vocabulary.token_rows(lines(["b a a", "c b d"])))
    encoded = vocabulary.encode_lines(log, words)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    found = {r["line_id"]: (r["ids"], r["length"]) for r in encoded.collect()}
    number = {r["word"]: r["idx"] for r in words.collect()}
    assert found == {0: ([number["b"], number["a"], number["a"]], 3), 1: ([number["c"], number["b"], number["d"]], 3), 2: ([vocabulary.UNKNOWN] * 1000, 1000), 5: ([vocabulary.UNKNOWN], 1)}


def test_blocks_are_fetched_once_however_many_lines_ask(spark, folder, monkeypatch):
    """Lines whose words lie in all blocks, more of them than a task remembers: the work was lines times blocks."""
    fetched, block = spark.sparkContext.accumulator(0), di.Dictionary._block

    def counted(self, number):
        before = self.fetched
        found = block(self, number)
        fetched.add(self.fetched - before)
        return found

    monkeypatch.setattr(di.Dictionary, "_block", counted)
    monkeypatch.setattr(di, "KNOWN", 100)
    monkeypatch.setattr(di, "LINES", 10)
    monkeypatch.setattr(di, "CHUNK_WORDS", 300, raising=False)
    r = random.Random(5)
    words = [f"w{i:04}" for i in range(2000)]
    path = di.write_dictionary(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, idx bigint"), folder(), 50)
    rows = [(i, [r.choice(words) if r.random() < 0.9 else "none" for _ in range(r.randint(0, 20))]) for i in range(1000)]
    found = di.encode(spark.createDataFrame(rows, "line_id bigint, tokens array<string>").repartition(4), path, "tokens", -1).collect()
    number = {w: i for i, w in enumerate(words)}
    assert {x["line_id"]: (x["ids"], x["length"]) for x in found} == {i: ([number.get(w, -1) for w in t], len(t)) for i, t in rows}
    blocks = len(di.Dictionary(path).blocks)
    assert blocks >= 40 and fetched.value <= blocks + 8  # a block that two tasks share


def test_lines_keep_their_other_columns(spark, folder):
    path = di.write_dictionary(spark.createDataFrame([("a", 5)], "word string, idx bigint"), folder())
    rows = [((1, None), "x", ["a", "b"]), (None, None, []), ((2, "k"), "", None)]
    found = di.encode(spark.createDataFrame(rows, "line_id struct<doc:bigint,pos:string>, source string, line array<string>"), path, "line", 1)
    assert found.columns == ["line_id", "source", "ids", "length"]
    assert sorted(str((x["line_id"] and tuple(x["line_id"]), x["source"], x["ids"], x["length"])) for x in found.collect()) == [
        "((1, None), 'x', [5, 1], 2)", "((2, 'k'), '', [], 0)", "(None, None, [], 0)"]


def test_lower_case_of_any_letters(spark, lines):
    log = lines(["FAILED a.B", "\u00c9t\u00c9 \u0130X", "\u039f\u03a3 A\u03a3\u0392 \u01c5"])
    rows = vocabulary.token_rows(log)
    number = {r["word"]: r["idx"] for r in vocabulary.vocabulary(rows).collect()}
    expected = {}
    for r in rows.withColumn("word", F.lower("token")).orderBy("line_id", "pos").collect():
        expected.setdefault(r["line_id"], []).append(number[r["word"]])
    words = spark.createDataFrame(list(number.items()), "word string, idx bigint")
    assert {r["line_id"]: r["ids"] for r in vocabulary.encode_lines(log, words).collect()} == expected


def test_first_places_of_near_and_far_ids(spark):
    """Ids on both sides of those that are compared as one long."""
    ids = [(1 << 42) - 1, 1 << 42, 0, -1, None, (1 << 42) + 1, 7]
    rows = spark.createDataFrame([(i, f"w{k} both{min(k, 1)}") for k, i in enumerate(ids)], "line_id bigint, line string")
    words = vocabulary.vocabulary(vocabulary.token_rows(rows)).orderBy("idx").collect()
    assert [r["word"] for r in words] == ["both1", "w4", "w3", "w2", "w6", "w0", "both0", "w1", "w5"]


def test_an_empty_vocabulary_and_no_lines(spark, lines):
    nothing = spark.createDataFrame([], "word string, idx bigint")
    assert [r["ids"] for r in vocabulary.encode_lines(lines(["a b"]), nothing).collect()] == [[vocabulary.UNKNOWN] * 2]
    assert vocabulary.encode_lines(lines([""]), nothing).collect() == []


def test_numbers_in_ranges(spark):
    r = random.Random(3)
    ids = [*{r.randrange(300, 1 << 62) * r.choice([1, -1]) for _ in range(500)}, *range(300)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "id bigint, text string").repartition(7)
    found = ranking.numbered_in_ranges(rows, ["id"], "n").collect()
    expected = {i: k for k, i in enumerate([None, *sorted(ids)], 1)}
    assert {x["id"]: x["n"] for x in found} == expected
    assert ranking.numbered_in_ranges(rows.filter("id = 0.5"), ["id"]).collect() == []


def test_lines_of_far_documents_are_told_apart(spark):
    documents = spark.createDataFrame([(i, "s", "one\n\ntwo") for i in (0, 1 << 24, 1 << 40, (1 << 62) + 1)], "doc_id bigint, source string, text string")
    found = document_lines(documents)
    assert found.select("line_id").distinct().count() == found.count() == 8
    words = vocabulary.vocabulary(vocabulary.token_rows(found)).orderBy("idx").collect()
    assert [(w["word"], w["occurrences"]) for w in words] == [("one", 4), ("two", 4)]
    first = found.filter(F.col("line_id.doc_id") == 1 << 40).orderBy("line_id").first()
    assert (first["line_id"]["doc_id"], first["line_id"]["pos"], first["line"]) == (1 << 40, 0, "one")
