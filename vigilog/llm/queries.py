"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilog.llm import blob_ledger, chat_events, containment, hamming_join, hard_negatives, kneser_ney, periodic_runs, piece_transducer
from vigilog.llm import pitman_yor, robust_outliers, subword_classifier, suffix_trees, warc_chunks
from vigilog.llm.common import table

#: The SentencePiece model, a parameter of its operator.
MODEL_FILE = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return robust_outliers.outlier_report(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))


@query
def op2_hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), 2)


@query
def op3_containment(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return containment.containment_report(documents, table(spark, folder, "benchmark").select("item_id", "text"))


@query
def op4_subword_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return subword_classifier.quality_report(documents, table(spark, folder, "labels").select("doc_id", "quality"))


@query
def op5_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return kneser_ney.toxicity_report(documents, table(spark, folder, "labels").select("doc_id", "toxic"))


@query
def op6_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_trees.cut_texts(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op7_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return blob_ledger.secret_report(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score_report(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op9_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return warc_chunks.archive_report(spark, table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op10_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    return piece_transducer.encoded(table(spark, folder, "documents").select("doc_id", "text"), MODEL_FILE)


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_report(periodic_runs.with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.negative_report(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


@query
def op13_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    return chat_events.format_report(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
