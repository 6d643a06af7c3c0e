import random

import pytest
import sentencepiece
from helpers_llm import docs  # noqa: F401

from vigilog.llm import piece_transducer as pt
from vigilog.llm.queries import MODEL_FILE


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)


@pytest.fixture(scope="module")
def machine():
    return pt.Transducer(pt.load_pieces(MODEL_FILE))


def texts(library):
    r = random.Random(1)
    alphabet = "aaabbeeinrst  ▁\t\n.é日本0101\U0001F600ｶ<>thenion\x00"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    out += ["".join(r.choice(pieces) for _ in range(r.randint(1, 7))) for _ in range(8000)]
    return out + [x * k for x in (" ", "a", "0", "=", "- ", "é", "ｶ") for k in range(70)] + ["", "<s> </s> <unk> <0x41>"]


def test_equals_the_library(library, machine):
    every = texts(library)
    for text, expected, found in zip(every, library.encode(every), machine.encode(every)):
        assert found.tolist() == expected, text
        assert machine.decode(expected).decode() == library.decode(expected), text


def test_documents(spark, library):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in pt.encoded(frame, MODEL_FILE).collect():
        expected = library.encode(rows[r["doc_id"]])
        assert r["ids"] == expected
        assert r["n_pieces"] == len(expected)
        assert r["n_byte_pieces"] == sum(library.is_byte(i) for i in expected)
        assert r["round_trip"]


def test_edge_cases(docs, library):
    long = "anybody\there " * 30_000 + "x" * 5000
    rows = [(1, None), (2, ""), (None, "a b"), (3, "dup"), (3, "dup"), (4, long), (5, " "), (6, "a▁b")]
    found = pt.encoded(docs(rows), MODEL_FILE).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=key) == sorted(((i, library.encode(t or "")) for i, t in rows), key=key)
    assert {r["doc_id"]: r["round_trip"] for r in found}[6] is False  # the mark comes back as a blank
    back = pt.decoded(docs(rows[3:5]).sparkSession.createDataFrame([(i, library.encode(t or "")) for i, t in rows] + [(9, None)], "doc_id bigint, ids array<int>"), MODEL_FILE)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=key) == sorted([(i, (t or "").replace("▁", " ")) for i, t in rows] + [(9, "")], key=key)


def test_empty_table(spark):
    assert pt.encoded(spark.createDataFrame([], "doc_id bigint, text string"), MODEL_FILE).collect() == []


def test_small_model():
    """Merges by rank, ties from the left, bytes for unknown characters; shown by hand."""
    pieces = [("<unk>", 0.0, "other")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    pieces += [("▁a", -3.0, "normal"), ("ab", -1.0, "normal"), ("bc", -2.0, "normal"), ("▁", -9.0, "normal"), ("a", -10.0, "normal"), ("b", -11.0, "normal"), ("c", -12.0, "normal")]
    machine = pt.Transducer(pieces)
    [ids] = machine.encode(["abc ac é"])
    spelled = [pieces[i][0] for i in ids]
    assert spelled == ["▁", "ab", "c", "▁a", "c", "▁", "<0xC3>", "<0xA9>"]


def unigram_pieces(seed=3):
    r = random.Random(seed)
    texts = {"▁", *"abcé", *("".join(r.choice("abcé") for _ in range(r.randint(2, 4))) for _ in range(30)), *("▁" + "".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(10))}
    pieces = [("<unk>", 0.0, "other")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return pieces + [(t, -float(r.randint(8, 96)) / 8, "normal") for t in sorted(texts)]


def test_unigram_equals_all_splits():
    """The sum of weights of every way to cut a word into pieces and characters in bytes."""
    pieces = unigram_pieces()
    machine = pt.Unigram(pieces)
    heaviest = max(machine.rank.values())
    r = random.Random(8)

    def ways(word):
        if not word:
            yield 0.0, []
        for n in range(1, len(word) + 1):
            head = word[:n]
            if head in machine.arcs:
                here, ids = machine.rank[head], [machine.arcs[head]]
            elif n == 1:
                here, ids = heaviest + pt.UNKNOWN, [machine.bytes[b] for b in head.encode()]
            else:
                continue
            for rest, more in ways(word[n:]):
                yield here + rest, ids + more

    for _ in range(150):
        word = "▁" + "".join(r.choice("abcéxyü") for _ in range(r.randint(0, 8)))
        [(_, ids)] = machine.paths([word])
        every = list(ways(word))
        least = min(w for w, _ in every)
        assert ids in [p for w, p in every if w == least]
    ids, same = machine.checked(["abc x  ü", "", "a▁b"])
    assert [machine.decode(i.tolist()).decode() for i in ids] == ["abc x  ü", "", "a b"] and same == [True, True, False]


def test_unigram_equals_the_library(tmp_path):
    """The library reads the same hand-made model."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    kinds = {"normal": 1, "byte": 6, "other": 2}
    for text, score, kind in unigram_pieces():
        model.pieces.add(piece=text, score=score, type=kinds[kind])
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = model.trainer_spec.UNIGRAM, True
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = True, False
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library, (kind, pieces) = sentencepiece.SentencePieceProcessor(model_file=str(path)), pt.load_model(str(path))
    assert kind is pt.Unigram
    machine, r = kind(pieces), random.Random(5)
    texts = ["".join(r.choice("aabbccé xü") for _ in range(r.randint(0, 30))) for _ in range(500)]
    weight = lambda ids: sum(library.get_score(i) for i in ids if not library.is_byte(i))
    for text, expected, found in zip(texts, library.encode(texts), machine.encode(texts)):
        assert found.tolist() == expected or weight(found.tolist()) == weight(expected), text  # of equal weights any path will do
