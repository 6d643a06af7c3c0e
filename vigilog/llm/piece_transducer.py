"""SentencePiece encoding and decoding by a weighted transducer.

A model file is compiled into three parts: the normaliser (a blank becomes U+2581, one
such mark is put before the text), the pieces (an arc for each, from the characters
to its id) and the byte fallback (an arc from a character without piece to the ids of its
bytes). An input is composed with them: the states are the places between its
characters, together with the last arc taken, the arcs are the pieces that lie there.
The result is the path of least weight in the tropical semiring (weights add up along a path,
of several paths the least counts).

A unigram model has its pieces' scores as weights. In a merge model (BPE) the order of
merges decides, which is a property of neighbours: pieces in a row are the model's
result just if every piece is its own result and no two neighbours would have merged
over their border. So an arc weighs 0 where it may follow the last one and infinity where
it may not; exactly one path of weight 0 exists, and it ends every beginning of the text in one
piece, so a place needs only one state. Whether two pieces may be neighbours is read off
their edges: the parts that end (begin) at the border, each with the rank of the
merge that made it and of the one that took it up.

No piece holds a mark behind another character, so the path of a text is the chain of the
paths of its words (marks, then other characters). Words come again and again, and their paths
are kept.

Merge and unigram models with byte fallback and the identity normaliser are taken; the path
of the file is a parameter. Others are refused. Defined cases: null texts are encoded as empty ones, empty texts have no
ids; repeated rows give a row each; other columns are not read. Decoding gives the text
back, but that U+2581 in a text comes back as a blank, as in the reference implementation of the format.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import small

MARK = "▁"
NEVER = float("inf")
KEPT_WORDS = 600_000
KEPT_PAIRS = 1_000_000
LONGEST_KEPT = 64
#: Texts are encoded together up to so many characters.
TOGETHER = 4 << 20
#: Ends of paths that are no piece: the start of a word, a character in bytes, no path at all.
START, BYTES, NONE = -1, -2, -3
#: A fixed value of the format: how much more a character without piece weighs than the heaviest piece.
UNKNOWN = 10.0
ENCODED = "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids array<int>, round_trip boolean"
#: A word: marks and what follows up to the next mark. Other parts never share a piece.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Machine:
    """What both kinds of models share. ``pieces``: (text, score, kind) by id; kinds are normal, byte, other."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.arcs: dict[str, int] = {}
        self.rank: dict[str, float] = {}  # weight of an arc, or the order of its merge
        self.surface: list[bytes] = [b""] * len(pieces)
        byte_ids = {}
        for i, (text, score, kind) in enumerate(pieces):
            if kind == "normal":
                if MARK in text.lstrip(MARK):
                    raise ValueError("a piece holds a mark behind another character")
                self.arcs[text], self.rank[text] = i, -score
                self.surface[i] = text.replace(MARK, " ").encode()
            elif kind == "byte":
                byte_ids[int(text[1:-1], 16)] = i
                self.surface[i] = bytes([int(text[1:-1], 16)])
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.arcs), default=0)
        self.words: dict[str, bytes] = {}
        self.inexact: set[str] = set()  # words whose ids do not spell them

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with the ids along its path of least weight."""
        raise NotImplementedError

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they decode to it.

        A text's ids are those of its words in a row, and so is what they decode to: each word is decoded once, when its path is found.
        """
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
            self.inexact.clear()
        fresh = set().union(*split).difference(known) if split else set()
        for word, ids in self.paths(sorted(fresh)):
            known[word] = array("i", ids).tobytes()
            if b"".join(map(self.surface.__getitem__, ids)) != word.replace(MARK, " ").encode():
                self.inexact.add(word)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
        same = [MARK not in t and self.inexact.isdisjoint(words) for t, words in zip(texts, split)]
        for word in [w for w in fresh if len(w) > LONGEST_KEPT]:
            del known[word]
        return out, same

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.checked(texts)[0]

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 of the text; the blank that the normaliser put before it is taken away."""
        return b"".join(map(self.surface.__getitem__, ids))[1:] if len(ids) else b""


class Unigram(Machine):
    """A model whose arcs have weights of their own: the negative scores of the pieces.

    A character that no piece of its own has an arc into its bytes, which weighs UNKNOWN more than any piece.
    """

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        bytes_weight = max(self.rank.values(), default=0.0) + UNKNOWN
        for word in words:
            n = len(word)
            least, back = [0.0] + [NEVER] * n, [(0, BYTES)] * (n + 1)
            for end in range(1, n + 1):
                for begin in range(max(0, end - self.longest), end):
                    piece = self.arcs.get(word[begin:end])
                    if piece is not None and (total := least[begin] + self.rank[word[begin:end]]) < least[end]:
                        least[end], back[end] = total, (begin, piece)
                if word[end - 1] not in self.arcs and (total := least[end - 1] + bytes_weight) < least[end]:
                    least[end], back[end] = total, (end - 1, BYTES)
            ids, end = [], n
            while end:
                begin, piece = back[end]
                ids.extend([piece] if piece >= 0 else (self.bytes[b] for b in reversed(word[begin:end].encode())))
                end = begin
            ids.reverse()
            yield word, ids


class Transducer(Machine):
    """A merge model, whose arcs weigh 0 or infinity by the arc before."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        super().__init__(pieces)
        self.runs = {len(t): i for t, i in self.arcs.items() if not t.strip(MARK)}
        if 1 not in self.runs or len({self.rank[MARK * n] for n in self.runs if n > 1}) > 1:
            raise ValueError("pieces of marks alone need one score")
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        for text in list(self.arcs):
            edges = self._edges(text)
            if edges is None:  # never the result of merges
                del self.arcs[text]
            else:
                self.left[text], self.right[text] = edges
        #: The states on the way back from the end of a piece: every ending of one, with the id of the piece or -1.
        self.tails = {text[n:]: -1 for text in self.arcs for n in range(1, len(text))} | self.arcs
        self.text_of = {i: text for text, i in self.arcs.items()}
        self.allowed: dict[int, bool] = {}

    def _edges(self, text: str):
        """The parts at both edges, innermost first, as (part, rank that made it, rank that took it up); None if not one piece."""
        parts = list(text)
        made = {c: -1.0 for c in parts}
        left, right = [[parts[0], -1.0, NEVER]], [[parts[-1], -1.0, NEVER]]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], NEVER), i))
            both = parts[best] + parts[best + 1]
            rank = self.rank.get(both, NEVER)
            if rank == NEVER:
                return None
            made[both] = rank
            if best == 0:
                left[-1][2] = rank
                left.append([both, rank, NEVER])
            if best == len(parts) - 2:
                right[-1][2] = rank
                right.append([both, rank, NEVER])
            parts[best:best + 2] = [both]
        return left, right

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether the arc of ``piece`` weighs 0 behind that of ``before``, and not infinity."""
        if len(self.allowed) >= KEPT_PAIRS:
            self.allowed.clear()
        found = self.allowed[before << 32 | piece] = not self._crosses(self.text_of[before], self.text_of[piece])
        return found

    def _crosses(self, before: str, piece: str) -> bool:
        for x, x_made, x_taken in self.right[before]:
            for y, y_made, y_taken in self.left[piece]:
                # Of equal merges the left one comes first: that inside ``before``, then the crossing one.
                rank = self.rank.get(x + y)
                if rank is not None and rank < x_taken and rank <= y_taken and max(x_made, y_made) < min(x_taken, y_taken):
                    return True
        return False

    def _marks(self, n: int) -> list[int]:
        """A run of marks. Pieces of marks alone share one score, so the leftmost merges first: the longest from the left."""
        ids = []
        while n:
            size = next(k for k in range(min(n, self.longest), 0, -1) if MARK * k in self.rank)
            ids.append(self.runs[size])
            n -= size
        return ids

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with the ids along its path of least weight; words in sorted order are fastest.

        What is known of a beginning holds for all words that share it, so only what follows
        the part shared with the word before is searched.
        """
        tails, allowed, surfaces = self.tails, self.allowed, self.bytes
        last: list[int] = [START]  # the arc that the path of weight 0 up to a place ends with
        back: list[int] = [0]
        previous = ""
        for word in words:
            if word[:2] == MARK * 2:
                yield word, self._marked(word)
                continue
            n, end = len(word), 0
            for x, y in zip(previous, word):
                if x != y:
                    break
                end += 1
            previous = word
            del last[end + 1:], back[end + 1:]
            while end < n:
                end += 1
                found, begin = NONE, end - 1
                while begin >= 0:
                    piece = tails.get(word[begin:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        before = last[begin]
                        if before >= 0:
                            fits = allowed.get(before << 32 | piece)
                            if self.may_follow(before, piece) if fits is None else fits:
                                found = piece
                                break
                        elif before != NONE:
                            found = piece
                            break
                    begin -= 1
                if found == NONE and word[end - 1] not in self.arcs:
                    found, begin = BYTES, end - 1
                last.append(found)
                back.append(begin)
            if last[n] == NONE:
                raise ValueError(f"no path through {word!r}")
            ids = []
            while n:
                begin = back[n]
                if last[n] >= 0:
                    ids.append(last[n])
                else:
                    ids.extend(surfaces[b] for b in reversed(word[begin:n].encode()))
                n = begin
            ids.reverse()
            yield word, ids

    def _marked(self, word: str) -> list[int]:
        """The path of a word with several marks before it."""
        marks = len(word) - len(word.lstrip(MARK))
        if marks == len(word):
            return self._marks(marks)
        [(_, ids)] = self.paths([word[marks - 1:]])
        alone = ids[0] == self.runs[1]  # else the last mark went into a piece with what follows
        return self._marks(marks) + ids[1:] if alone else self._marks(marks - 1) + ids



def load_model(model_file: str) -> tuple[type[Machine], list[tuple[str, float, str]]]:
    """The kind and the pieces of a model file; refuses models that are normalised or built otherwise."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
    kinds = {trained.BPE: Transducer, trained.UNIGRAM: Unigram}
    if not (plain and rules.escape_whitespaces and trained.byte_fallback and trained.model_type in kinds):
        raise ValueError("only merge and unigram models with byte fallback and the identity normaliser are taken")
    loaded = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if loaded.is_byte(i) else "other" if loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i) else "normal"
    return kinds[trained.model_type], [(loaded.id_to_piece(i), loaded.get_score(i), kind(i)) for i in range(loaded.vocab_size())]


def load_pieces(model_file: str) -> list[tuple[str, float, str]]:
    return load_model(model_file)[1]


def encoded(documents: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids, round_trip`` for ``documents(doc_id, text)``.

    ``round_trip`` tells whether the decoded ids are the text. The pieces of the model travel with the
    job (their number is fixed by the model file), so executors need no copy of the file.
    """
    machine_of, pieces = load_model(model_file)
    kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "n_byte_pieces": pa.int64(), "ids": pa.list_(pa.int32()), "round_trip": pa.bool_()}

    def run(parts):
        machine = machine_of(pieces)
        is_byte = np.zeros(len(pieces), bool)
        is_byte[machine.bytes] = True

        def batch_of(docs, ids, same):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            fallback = np.concatenate([[0], np.cumsum(is_byte[flat])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            counts = [np.diff(offsets), np.diff(fallback[offsets])]
            columns = [pa.array(docs, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), lists, pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=list(kinds))

        docs, texts, size = [], [], 0
        for batch in parts:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append(doc)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield batch_of(docs, *machine.checked(texts))
                    docs, texts, size = [], [], 0
        if docs:
            yield batch_of(docs, *machine.checked(texts))

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(small(run), ENCODED)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` for ``rows(doc_id, ids)``; null ids decode to an empty text."""
    machine_of, pieces = load_model(model_file)

    def run(parts):
        machine = machine_of(pieces)
        for batch in parts:
            texts = [machine.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
