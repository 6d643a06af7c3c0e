"""A training-data pipeline over ``documents``: toxicity, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and is written
as Parquet, which the next stage reads. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilog.llm import blob_ledger, containment, hamming_join, kneser_ney, piece_transducer
from vigilog.llm.common import stored, table
from vigilog.llm.queries import MODEL_FILE


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go. A null text is not toxic."""
    return kneser_ney.ordinary_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles (similarity 0.8) the one with the least id stays.

    Rows with one id stay or go together; texts without words are no copies.
    """
    return hamming_join.one_of_each(docs, 5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of the five-word shingles of a benchmark item go."""
    return containment.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return blob_ledger.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the ids of its pieces, with their number and whether they decode to the text."""
    return piece_transducer.encoded(docs.select("doc_id", "text"), MODEL_FILE)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the trained models nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
