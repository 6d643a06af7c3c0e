"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import fold

FOLDS = 5
#: Characters of the pieces in which a trainer gets a text; the cuts are behind words, but for longer words.
PIECE = 50_000


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> DataFrame:
    """``doc_id, rank, text, label``: at most ``per_class[label]`` labelled documents of each class, by the order of a hash.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are taken. Ids with no or with
    conflicting labels are left out, repeated ids count once (the smallest text stands for them).
    The ids chosen are bounded by ``per_class``, so the broadcast is, and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter((fold("doc_id", FOLDS) != 0) & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most")
    known = known.withColumn("rank", F.xxhash64(F.concat(F.lit("sample "), F.col("doc_id").cast("string"))))
    spark, chosen = documents.sparkSession, []
    for value, most in per_class.items():
        chosen += [tuple(r) for r in known.filter(F.col("label") == value).orderBy("rank", "doc_id").limit(most).select("doc_id", "rank", "label").collect()]
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, rank bigint, label int"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(ids, "doc_id")
    return found.groupBy("doc_id", "rank", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def in_pieces(sampled: DataFrame, piece: int = PIECE) -> DataFrame:
    """``doc_id, rank, label, piece, text`` in one partition and in order, for a trainer that holds a piece at a time."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece - 1}}}(?:[\\x20\\x09-\\x0D]|\\z)|.{{1,{piece}}}"), F.lit(0))
    parts = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    rows = sampled.select("doc_id", "rank", "label", F.posexplode(parts).alias("piece", "text"))
    return rows.repartition(1).sortWithinPartitions("rank", "label", "doc_id", "piece")


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """(rank, label, pieces) of each document of such a partition."""
    rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
    for (rank, label, _), group in itertools.groupby(rows, lambda r: (r[1], r[2], r[0])):
        yield rank, label, (r[4].encode() for r in group)
