"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Nulls in any column, empty and long texts, repeated rows and empty tables pass as each stage's docstring says; extra
columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomgrid.llm import exact_dedup, language, mixing, ngram_join, pieces
from fathomgrid.llm.common import ready, written
from fathomgrid.llm.queries import PIECES


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language stay; texts in none of them, without a letter, empty and null ones go.

    The string kernels' regression names each text's language, and the text stays if that language's landmarks know enough
    of its 3-grams. The model learns from the labelled rows of docs; without any, every text with a letter stays. A row stays
    or goes by its own text alone, so repeated rows fare alike.
    """
    ready(spark)
    return language.keep_identified(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased), one stays: that of the largest doc_id, one of its rows if repeated."""
    ready(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, that of the least doc_id stays."""
    ready(spark)
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, once or repeated."""
    ready(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256) of every row."""
    ready(spark)
    return pieces.encode_digest(docs, PIECES, extra=("source",))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("sentencepiece", encoded)]

#: A kernel classifier, seeded mixing and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


