"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles gets a signature of CHUNKS x WIDTH symbols of 8 bits, each
from one MinHash function. Two signatures differ in about a fifth of their symbols when the
sets have a Jaccard similarity of 0.8. By the pigeonhole principle, signatures that
differ in at most CHUNKS x (ERRORS + 1) - 1 = 27 of 98 symbols agree, in one chunk at least, in all but
ERRORS = 1 of its symbols. So for each chunk every way to leave out one symbol is an index
key, and all pairs within that distance meet in a key. Links at a similarity of just 0.8 are
within the distance with a probability of 0.97, and meet with one of 0.99999, as errors are seldom spread evenly.

Pairs that meet are confirmed on their full sets. Not every pair needs to be looked at to
know who is connected:

1. texts with equal sets are one class, found by a hash of the set;
2. every class is compared with the centre of each key it is in: the class that meets most others, over all its keys. In a
   group of copies that is the one with the fewest changes, so most classes have the same few centres and are linked with
   one; of more than CENTRES those that come first by a hash are taken, so a class has a bounded number of comparisons;
3. components of these links are formed. Only keys with several components are looked at again, and of their
   classes only those that have a class of another component near them, by the lowest bits of their signatures;
4. of the classes left, a pair is compared if it lies in different components and passes the prefix filter: of a link's two
   sets, the rarest ninth of the smaller one and the rarest fifth of the larger one share a shingle,
   rarity being counted over the classes left. Many copies that differ too much from each other
   to be linked, each in shingles of its own, are so told apart without looking at their pairs. Copies that share most of one
   text pass it; of these, the join itself drops a pair whose parity sketches differ in more bits than a link's sets do in
   shingles, which no link can. Sets of many times SKETCH x 64 shingles fill the sketch, which then drops less.

So two connected texts end in one component just as if all pairs that meet had been compared. Keys and shingles are
grouped with sums made in every task; where a large component meets others in a key, the others are
joined with it, never the component with itself.

Defined cases: null texts and texts without words have no shingles and are linked with nothing;
fewer words than a shingle has are one shingle; repeated rows are one class; rows without id
take part, but never name a component unless no row of it has an id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import WordHash, byte_texts, free_name, shingle_hashes64, small, stored
from vigilog.llm.components import components

CHUNKS, WIDTH, ERRORS = 14, 7, 1
SYMBOLS = CHUNKS * WIDTH
#: Signatures of linked texts differ in more symbols than this with a probability under 1e-10.
MOST_DIFFERENT = 50
#: The same for the lowest bits of the symbols.
MOST_BITS = 32
#: Centres that a class is compared with at first.
CENTRES = 48
#: Numbers of 64 bits in a parity sketch.
SKETCH = 16
BLOCK = 1 << 14
MULTIPLIERS = np.random.default_rng(2).integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
SIGNED = "doc_id bigint, n bigint, whole binary, signature binary, bits1 bigint, bits2 bigint"
SETS = "whole binary, grams array<bigint>, sketch array<bigint>"


def signature(hashes: np.ndarray) -> bytes:
    """A byte for each MinHash function, from distinct 64-bit shingle hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), BLOCK):  # a very long text needs no more memory
        part = np.multiply.outer(MULTIPLIERS, short[at:at + BLOCK])
        np.minimum(least, part.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def lowest_bits(sign: bytes) -> tuple[int, int]:
    """The lowest bits of the symbols as two numbers."""
    packed = np.packbits(np.frombuffer(sign, np.uint8) & 1, bitorder="little").tobytes().ljust(16, b"\0")
    return tuple(np.frombuffer(packed, np.int64).tolist())


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """For each of SKETCH x 64 places whether an odd number of shingles falls there.

    A place differs between two sets only if a shingle there is in one of them alone, so no more places differ than shingles.
    """
    odd = np.bincount((grams >> np.uint64(32)).astype(np.int64) % (SKETCH * 64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def distinct_shingles(text: bytes, size: int, cache: WordHash) -> np.ndarray:
    return np.unique(shingle_hashes64(text.lower().split(), cache, size))


def signed(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, whole, signature, bits1, bits2``: number of shingles, hash of the set, signature; null without shingles."""

    def run(parts):
        cache = WordHash()
        for batch in parts:
            rows = []
            for text in byte_texts(batch.column("text")):
                distinct = distinct_shingles(text, size, cache)
                if len(distinct):
                    sign = signature(distinct)
                    rows.append((len(distinct), xxhash.xxh3_128_digest(distinct.tobytes()), sign, *lowest_bits(sign)))
                else:
                    rows.append((0, None, None, None, None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in SIGNED.split(", ")]
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(small(run), SIGNED)


def index_keys(sign: str) -> Column:
    """An array of keys: for each chunk and each way to leave out a symbol, a hash of the others."""
    keys = []
    for c in range(CHUNKS):
        for d in range(WIDTH):
            rest = F.concat(F.substring(sign, c * WIDTH + 1, d), F.substring(sign, c * WIDTH + d + 2, WIDTH - 1 - d))
            keys.append(F.xxhash64(F.lit(c * WIDTH + d), rest))
    return F.array(*keys)


def similar_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` of short ids, the ``whole_a, whole_b`` whose sizes and signatures allow a link."""
    side = lambda x: classes.select(F.col("short").alias(x), F.col("whole").alias(f"whole_{x}"), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.col("n_a") * 100 >= F.col("n_b") * 80
    sizes = sizes & (F.col("n_b") * 100 >= F.col("n_a") * 80)

    def run(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for x in ("s_a", "s_b")]
            near = (s[0] != s[1]).sum(axis=1) <= MOST_DIFFERENT
            yield batch.select(["whole_a", "whole_b"]).filter(pa.array(near))

    return both.filter(sizes).select("whole_a", "whole_b", "s_a", "s_b").mapInArrow(run, "whole_a binary, whole_b binary").distinct()


def full_sets(wanted: DataFrame, classes: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """SETS of the ``wanted(whole)``: the hashes of all shingles.

    A text is looked up by the least id of its class; ids may be repeated, so it must have the set that is asked for.
    """
    holders = wanted.join(classes.select("whole", "rep"), "whole").withColumn("key", _key("rep"))
    texts = documents.select(_key("doc_id").alias("key"), "text").join(holders, "key").select("whole", "text")

    def run(parts):
        cache = WordHash()
        for batch in parts:
            rows = []
            for whole, text in zip(batch.column("whole").to_pylist(), byte_texts(batch.column("text"))):
                distinct = distinct_shingles(text, size, cache)
                if xxhash.xxh3_128_digest(distinct.tobytes()) == whole:
                    rows.append((whole, distinct.view(np.int64), parity_sketch(distinct)))
            if rows:
                whole, *lists = zip(*rows)
                offsets = [np.concatenate([[0], np.cumsum([len(x) for x in each])]) for each in lists]
                arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(each))) for at, each in zip(offsets, lists)]
                yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), *arrays], names=["whole", "grams", "sketch"])

    return texts.mapInArrow(small(run), SETS).dropDuplicates(["whole"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(whole_a, whole_b)`` whose full sets have a Jaccard similarity of 0.8 or more."""
    side = lambda x: sets.select(F.col("whole").alias(f"whole_{x}"), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("a"), "whole_a").join(side("b"), "whole_b")

    def run(parts):
        for batch in parts:
            keep = []
            for a, b in zip(batch.column("grams_a"), batch.column("grams_b")):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= 80 * (len(a) + len(b) - shared))
            yield batch.select(["whole_a", "whole_b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("whole_a", "whole_b", "grams_a", "grams_b").mapInArrow(small(run), "whole_a binary, whole_b binary")


def in_mixed_groups(rows: DataFrame, group: str) -> DataFrame:
    """Those ``rows(group, root, ...)`` whose group has several roots, with ``main``, the root of most rows of the group."""
    sizes = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n_root"))
    main = sizes.groupBy(group).agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.count(F.lit(1)).alias("n_roots"))
    return rows.join(main.filter("n_roots > 1").select(group, "main"), group)


def _sizes_fit(x: str, y: str) -> Column:
    return (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * 80) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * 80)


def still_open(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """``short`` of classes that share a key with a class of another component that is near them.

    ``met(key, short)``; ``nodes(short, root, n, bits1, bits2)``.
    """
    mixed = stored(in_mixed_groups(met.select("key", "short").join(nodes, "short"), "key"), "mixed")
    bits = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1"))) + F.bit_count(F.col("x.bits2").bitwiseXOR(F.col("y.bits2")))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _sizes_fit("x", "y") & (bits <= MOST_BITS)
    other, main = mixed.filter("root <> main"), mixed.filter("root = main")
    found = other.alias("x").join(mixed.alias("y"), near, "left_semi").select("short")
    return found.unionAll(main.alias("x").join(other.alias("y"), near, "left_semi").select("short")).distinct()


def pairs_left(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of different components that pass the prefix filter and the sketches, of ``sets(short, root, n, grams, sketch)``."""
    rows = sets.select("short", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = rows.join(counts, "gram").groupBy("short").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("shared"))
    # A link of sets with n <= m shingles shares at least 8/9 of n, and at least 4/5 of m.
    alone = F.col("n") - F.size("shared")
    smaller, larger = (F.col("n") - F.ceil(F.col("n") * part) + 1 - alone for part in (F.lit(8.0) / 9 - 1e-12, F.lit(0.8) - 1e-12))
    first = lambda m: F.slice("shared", 1, F.greatest(m, F.lit(0)).cast("int"))
    ready = sets.select("short", "root", "n").join(shared, "short").select("short", "root", "n", alone.alias("alone"), first(smaller).alias("few"), first(larger).alias("more"))
    ready = stored(ready, "prefixes")
    each = ready.select("short", "root", "n", "alone", F.posexplode("more").alias("at", "p"), F.size("few").alias("few"))
    rest = (F.col("n") - F.col("alone") - F.col("at")).alias("rest")  # shingles from this one on, in the order of rarity
    each = each.select("short", "root", "n", F.col("p.gram").alias("gram"), (F.col("at") < F.col("few")).alias("leads"), rest)
    mixed = stored(in_mixed_groups(each, "gram").join(sets.select("short", "sketch"), "short"), "mixed")
    leading = mixed.filter("leads")
    # Behind the first shared shingle both sets must have enough left to share four ninths of their sizes' sum.
    enough = F.least("x.rest", "y.rest") * 9 >= (F.col("x.n") + F.col("y.n")) * 4
    # A link's sets have at most a ninth of their sizes' sum outside of what they share.
    apart = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    enough = enough & (apart * 9 <= F.col("x.n") + F.col("y.n"))
    fits = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.n")) & _sizes_fit("x", "y") & enough
    one = leading.filter("root <> main").alias("x").join(mixed.alias("y"), fits)
    two = leading.filter("root = main").alias("x").join(mixed.filter("root <> main").alias("y"), fits)
    return one.select("x.short", F.col("y.short").alias("b")).unionAll(two.select("x.short", F.col("y.short").alias("b"))).select(
        F.least("short", "b").alias("a"), F.greatest("short", "b").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("whole_a", "whole_b")).alias("whole")).distinct()


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("p"), F.col(name).cast("string")), F.lit(""))


def near_duplicates(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for ``documents(doc_id, text)`` and shingles of ``size`` words."""
    rows = stored(signed(documents, size), "signed")
    first = [F.first(x).alias(x) for x in ("n", "signature", "bits1", "bits2")]
    classes = rows.filter("whole IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("rep"), *first)
    classes = stored(classes.withColumn("short", F.xxhash64("whole")), "classes")

    index = classes.select("short", F.explode(index_keys("signature")).alias("key"))
    shared = index.groupBy("key").agg(F.min("short").alias("low"), F.max("short").alias("high"), F.count(F.lit(1)).alias("n_key"))
    met = stored(index.join(shared.filter("low < high").select("key", "n_key"), "key"), "met")

    known = met.groupBy("short").agg(F.sum("n_key").alias("others"))
    centres = met.select("key", "short").join(known, "short").groupBy("key").agg(F.max(F.struct("others", "short")).alias("centre"))
    star = met.select("key", "short").join(centres.select("key", F.col("centre.short").alias("b")), "key").filter("short <> b")
    # One centre for each of a class's keys, so the sets are bounded.
    asked = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("b").alias("place"), "b"))), 1, CENTRES)
    star = star.groupBy("short").agg(asked.alias("c")).select("short", F.explode("c.b").alias("b"))
    star = star.select(F.least("short", "b").alias("a"), F.greatest("short", "b").alias("b")).distinct()
    near = stored(similar_enough(star, classes), "near")
    sets = stored(full_sets(_ends(near), classes, documents, size), "sets")
    links = stored(confirmed(near, sets), "confirmed")

    root = components(links.select(F.col("whole_a").alias("a"), F.col("whole_b").alias("b"))).withColumnRenamed("node", "whole")
    nodes = classes.select("whole", "short", "n", "bits1", "bits2").join(root, "whole", "left")
    nodes = stored(nodes.withColumn("root", F.xxhash64(F.coalesce("root", "whole"))).drop("whole"), "nodes")
    left = stored(classes.select("whole", "short").join(still_open(met, nodes), "short"), "open")
    missing = stored(left.select("whole").join(sets.select("whole"), "whole", "left_anti"), "missing")
    if missing.limit(1).count():  # only then all texts are read once more
        sets = sets.unionAll(stored(full_sets(missing, classes, documents, size), "sets"))
    left_sets = left.join(nodes, "short").join(sets, "whole").select("short", "root", "n", "grams", "sketch")
    rest = stored(similar_enough(pairs_left(left_sets), classes), "near").join(near, ["whole_a", "whole_b"], "left_anti")
    more = confirmed(rest, sets)  # between components, so only these are connected once more
    for x in ("a", "b"):
        end = root.select(F.col("whole").alias(f"whole_{x}"), F.col("root").alias(x))
        more = more.join(end, f"whole_{x}", "left").withColumn(x, F.coalesce(x, f"whole_{x}"))
    joined = components(more.select("a", "b"))

    of_class = classes.select("whole", "rep").join(root, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    of_class = of_class.join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    of_class = of_class.select("whole", "rep", F.coalesce("last", "root").alias("root"))
    named = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = of_class.join(named, "root").select("whole", "component_id")
    out = rows.select("doc_id", "n", "whole").join(labels, "whole", "left")
    component = F.when(F.col("whole").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(documents: DataFrame, size: int = 5) -> DataFrame:
    """``documents`` without near copies: of every component the rows of its least id stay, with all columns."""
    copy = free_name(documents, "_copy")
    gone = stored(near_duplicates(documents, size).filter("NOT kept").select(F.col("doc_id").alias(copy)).distinct(), "copies")
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone[copy]), "left_anti")
