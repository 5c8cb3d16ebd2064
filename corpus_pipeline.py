"""A training corpus from documents: language, exact copies, near copies, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuentaclara.llm import exact_dedup, jaccard_join, language_id, mixing, sentence_pieces
from cuentaclara.llm.common import dropped, small_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, a missing lang filled in; those without text or without a letter go, also where no language can be learned."""
    small_batches(spark)
    return language_id.identified_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the row with the smallest doc_id stays."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a 5-gram Jaccard similarity of 0.80 or more the one with the smallest doc_id stays."""
    small_batches(spark)
    return jaccard_join.kept_rows(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, so that the sources meet their targets."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, the ids, and digests of the ids and of the text they decode to."""
    small_batches(spark)
    return sentence_pieces.encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The language model, the linked components and the tokenizer have no counterpart in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "corpus-" + name.split()[0].lower())
        if before is not None:  # the table of the stage before is read no more
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
