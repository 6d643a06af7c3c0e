"""Substring dedup by prefix-partitioned suffix trees.

A passage is repeated when a run of WINDOW words of one text is also found in a text with a
smaller id. The runs are beginnings of suffixes: two texts share a run just if their
suffixes share a node of depth WINDOW in the suffix tree of all texts. The tree is built in
parts:

1. Anchors. Of the ANCHOR-word grams inside a window the one with the least hash is the window's anchor,
   the same one wherever the window stands. Neighbouring windows share anchors, so a text has about
   one for every twenty words. Anchors found in one text only are dropped; the windows of the others are
   the live suffixes, all that can reach a deep node. Of texts that are equal as a whole, the one with
   the least id takes part; in the others every window is repeated.
2. Groups. Live suffixes are dealt out by a prefix of variable length: by the gram that begins at their anchor
   where it has at most GROUP suffixes, by all their WINDOW words where it has more. A task of the first kind gets, for each
   occurrence of the gram, the stretch of words that its suffixes cover, once, and not a copy
   for every suffix. A group of the second kind is a single deep node, of which only the least id is needed: it
   is summed up in every task before the shuffle, however many texts hold it.
3. Subtrees. In a task the suffixes of its groups, cut at WINDOW words, are sorted; the length of the
   common prefix of neighbours gives the inner nodes. Those of depth WINDOW with leaves
   in several texts are maximal repeats of at least that length; under each, every leaf but those
   of the least id is marked.

Marked windows come back as ranges of words, and the texts that have any are cut.

Words are compared as 64-bit hashes, whole texts as MD5. Defined cases: null texts have no words; texts shorter
than a window keep all words; a passage repeated inside one text only stays; rows with one id
never remove each other's words; rows without id count as one last text; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import WordHash, byte_texts, small, mixed, stored

WINDOW = 50
ANCHOR = 8
#: Suffixes in a group that a task holds: their cut words take 8 x WINDOW bytes each.
GROUP = 50_000
LAST = (1 << 63) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)
FOUND = "id bigint, whole binary, anchors array<bigint>, windows array<int>"
STRETCH = "anchor bigint, id bigint, whole binary, begin bigint, words binary"
SUFFIX = "anchor bigint, run bigint, id bigint, whole binary, begin bigint"
RANGE = "id bigint, whole binary, begin bigint, end bigint"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


# ---------------------------------------------------------------- one text

def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        total = total * STEP + hashes[i:len(total) + i]
    return mixed(total)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For every window, the hash of its anchor: the least one of its grams."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    least, reach, width = run_hashes(hashes, ANCHOR), 1, WINDOW - ANCHOR + 1
    while reach * 2 <= width:  # minima over 2, 4, 8, ... grams
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[:-rest], least[rest:])
    return least.view(np.int64)


def runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and ends of the runs of windows with one anchor."""
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    return (np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])) if len(anchor) else (cuts, cuts)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


# ---------------------------------------------------------------- subtrees

def deep_leaves(groups: np.ndarray, ids: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Which suffixes lie below a node of full depth with a smaller id below it too.

    ``suffixes`` has a row of WINDOW word hashes for each; a node never spans two groups.
    """
    rows = np.ascontiguousarray(np.concatenate([groups.view(np.uint64)[:, None], suffixes], axis=1))
    order = np.argsort(rows.view(f"V{rows.shape[1] * 8}").ravel(), kind="stable")
    equal = rows[order][1:] == rows[order][:-1]
    depth = np.where(equal.all(axis=1), WINDOW, equal[:, 1:].argmin(axis=1) * equal[:, 0])  # common prefix of neighbours
    node = np.concatenate([[0], np.cumsum(depth < WINDOW)])
    least = np.full(node[-1] + 1, LAST, np.int64)
    np.minimum.at(least, node, ids[order])
    marked = np.empty(len(ids), bool)
    marked[order] = ids[order] > least[node]
    return marked


def subtree_ranges(stretches: list[tuple]) -> Iterator[tuple]:
    """The marked ranges of all stretches of some groups, as RANGE rows."""
    words = [np.frombuffer(s[4], np.uint64) for s in stretches]
    sizes = np.array([len(w) - WINDOW + 1 for w in words])
    suffixes = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, WINDOW) for w in words])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    groups, ids = np.array([s[0] for s in stretches], np.int64), np.array([s[1] for s in stretches], np.int64)
    marked = deep_leaves(groups[owner], ids[owner], suffixes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for k in np.unique(owner[marked]):
        at = np.flatnonzero(marked[first[k]:first[k + 1]])
        _, doc, whole, begin, _ = stretches[k]
        for low, high in zip(at[np.concatenate([[True], np.diff(at) > 1])], at[np.concatenate([np.diff(at) > 1, [True]])]):
            yield doc, whole, begin + int(low), begin + int(high) + WINDOW


# ---------------------------------------------------------------- tables

def _batches(rows: Iterator[tuple], ddl: str, most: int) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _identified(documents: DataFrame) -> DataFrame:
    """``doc_id, id, whole, text``: an id for every row, and a hash of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("bigint")
    return documents.select(
        doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("whole"), text.alias("text")
    )


def anchored(texts: DataFrame) -> DataFrame:
    """The distinct anchors of every text and the number of windows each has."""

    def run(parts):
        cache = WordHash()
        for batch in parts:
            lists, counts = [], []
            for text in byte_texts(batch.column("text")):
                found, n = np.unique(anchors(word_hashes(text.split(), cache)), return_counts=True)
                lists.append(found)
                counts.append(n)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (lists, counts)]
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in zip(flat, (pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("whole"), *arrays], names=["id", "whole", "anchors", "windows"])

    return texts.select("id", "whole", "text").mapInArrow(small(run), FOUND)


def stretch_table(texts: DataFrame) -> DataFrame:
    """The stretches of ``texts(id, whole, text, live)`` that the live anchors cover."""

    def rows(parts):
        cache = WordHash()
        for batch in parts:
            for doc, whole, text, live in zip(*(batch.column(c).to_pylist() for c in ("id", "whole")), byte_texts(batch.column("text")), batch.column("live")):
                hashes = word_hashes(text.split(), cache)
                anchor = anchors(hashes)
                begins, ends = runs(anchor)
                keep = np.isin(anchor[begins], live.values.to_numpy())
                for a, begin, end in zip(anchor[begins[keep]].tolist(), begins[keep].tolist(), ends[keep].tolist()):
                    yield a, doc, whole, begin, hashes[begin:end + WINDOW - 1].tobytes()

    return texts.select("id", "whole", "text", "live").mapInArrow(small(lambda parts: _batches(rows(parts), STRETCH, 2000)), STRETCH)


def suffix_table(texts: DataFrame) -> DataFrame:
    """A row for each suffix of ``texts(id, whole, text, crowded)`` with a crowded anchor: ``run`` stands for its words."""

    def rows(parts):
        cache = WordHash()
        for batch in parts:
            for doc, whole, text, crowded in zip(*(batch.column(c).to_pylist() for c in ("id", "whole")), byte_texts(batch.column("text")), batch.column("crowded")):
                hashes = word_hashes(text.split(), cache)
                anchor, run = anchors(hashes), run_hashes(hashes, WINDOW).view(np.int64)
                for at in np.flatnonzero(np.isin(anchor, crowded.values.to_numpy())).tolist():
                    yield int(anchor[at]), int(run[at]), doc, whole, at

    return texts.select("id", "whole", "text", "crowded").mapInArrow(small(lambda parts: _batches(rows(parts), SUFFIX, 20_000)), SUFFIX)


def marked_in_subtrees(stretches: DataFrame) -> DataFrame:
    """RANGE rows from the subtrees of all groups; a task holds whole groups, of GROUP suffixes together or one at least."""

    def rows(parts):
        held, size = [], 0
        for batch in parts:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "whole", "begin", "words"))):
                if size >= GROUP and row[0] != held[-1][0]:
                    yield from subtree_ranges(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 8 - WINDOW + 1
        if held:
            yield from subtree_ranges(held)

    sorted_rows = stretches.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_rows.mapInArrow(lambda parts: _batches(rows(parts), RANGE, 20_000), RANGE)


def repeated_ranges(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """``id, whole, copy, ranges`` of those ``texts(id, whole, text)`` that repeat words of a smaller id.

    ``copy``: the text as a whole is that of a smaller id. ``ranges``: else, the words to remove.
    """
    found = stored(anchored(texts), "anchored")
    first = stored(found.groupBy("whole").agg(F.min("id").alias("id"), F.first("anchors").alias("anchors"), F.first("windows").alias("windows")), "first")
    copies = found.select("id", "whole").join(first.select("whole", F.col("id").alias("least")), "whole").filter("id > least")

    each = first.select("id", "whole", F.explode(F.arrays_zip("anchors", "windows")).alias("a")).select(
        "id", "whole", F.col("a.anchors").alias("anchor"), F.col("a.windows").alias("windows"))
    groups = each.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("windows").alias("suffixes"))
    groups = groups.filter("low < high").select("anchor", (F.col("suffixes") > group).alias("crowded"))
    live = each.join(groups, "anchor").groupBy("id", "whole").agg(
        F.collect_list(F.when(~F.col("crowded"), F.col("anchor"))).alias("live"),
        F.collect_list(F.when(F.col("crowded"), F.col("anchor"))).alias("crowded"),
    )
    chosen = stored(texts.join(live, ["id", "whole"]), "live")

    ranges = marked_in_subtrees(stretch_table(chosen.filter(F.size("live") > 0)))
    suffixes = stored(suffix_table(chosen.filter(F.size("crowded") > 0)), "suffixes")
    least = suffixes.groupBy("anchor", "run").agg(F.min("id").alias("least"))
    crowded = suffixes.join(least, ["anchor", "run"]).filter("id > least")
    crowded = crowded.select("id", "whole", "begin", (F.col("begin") + WINDOW).alias("end"))
    marked = ranges.unionAll(crowded).groupBy("id", "whole").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    none = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")
    return marked.select("id", "whole", F.lit(False).alias("copy"), "ranges").unionAll(
        copies.distinct().select("id", "whole", F.lit(True).alias("copy"), none.alias("ranges")))


def cut_texts(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for ``documents(doc_id, text)``, a row for each row."""
    texts = _identified(documents)
    repeated = stored(repeated_ranges(texts.select("id", "whole", "text"), group), "ranges")
    joined = texts.join(repeated, ["id", "whole"], "left")

    def run(parts):
        for batch in parts:
            rows = []
            for text, copy, ranges in zip(byte_texts(batch.column("text")), *(batch.column(c).to_pylist() for c in ("copy", "ranges"))):
                words = text.split()
                n = len(words)
                gone = [(0, n)] if copy and n >= WINDOW else merged([(r["begin"], r["end"]) for r in ranges or ()])
                for begin, end in reversed(gone):
                    del words[begin:end]
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return joined.select("doc_id", "text", "copy", "ranges").mapInArrow(small(run), RESULT)
