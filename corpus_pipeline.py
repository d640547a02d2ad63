"""The pipeline over ``documents``: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from innsight.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_bpe
from innsight.llm.common import delete, shared_folder, temporary


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the dictionaries learn from the labels of three remainders of four.

    A null, empty or letterless text is rejected; repeated rows stay repeated.
    """
    return language_id.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that of the least doc_id, null last.

    A null text is empty; of rows equal in text and doc_id one stays.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the least doc_id, null last.

    Texts without words link with nothing and stay; of repeated rows one stays.
    """
    return ngram_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights; a document that its source repeats is there as often as it is taken.

    Texts without words are never taken; the null source is a source; repeated rows are all taken or none.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded text of each row of the mix; a null text is empty."""
    encoded = sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.digests(encoded, "ids")


STAGES = [
    ("language_id", tell_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Compression classification can't be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when its output is written, its input when the next has been."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
