"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, mixing, near_vectors, ngram_join, page_text, pieces, quality, token_counts, transcripts
from .common import ready, written

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(divisor: int, value: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor)) == value


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents gets a score, a null or empty text too (its rates are then the usual ones); repeated rows get equal
    ones. A null doc_id counts as empty text in the choice of what is held out, and is joined with no label."""
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _held_out(5, 0))
    return scores.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; texts without words link with nothing, rows of equal texts with each other. A null doc_id
    is no least one unless its component has no other."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of embeddings; unusable vectors and null labels link with nothing, identical vectors with each other."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of pages, repeated ones too; null, empty and text-less pages give an empty text."""
    return page_text.page_texts(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; texts without a letter, null and empty ones are `und`. A null doc_id counts as empty text in
    the choice of what is held out. Without any labelled row, every text is `und`."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, held_out=_held_out(4, 2))
    return language.identify(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits of its own: an insertion, a deletion and a replacement
    at places that its id and length choose."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1)
    edit = lambda at, size, text: F.struct(at.alias("start"), (at + size).alias("stop"), F.lit(text).alias("text"))
    edits = F.array(edit(place(1), 0, " an inserted remark,"), edit(place(2), 24, ""), edit(place(3), 5, "won't\n\n42"))
    return token_counts.edited_counts(docs.select("doc_id", "text", edits.alias("edits")), RANKS)


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as raw lines: each turn's text, after a speaker marker in the conversation's style; some turns
    have none and are set off by a blank line."""
    turns = table(spark, sf_dir, "conversations")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    known = F.coalesce(F.col("role"), F.lit("user"))
    name = F.when(style == 0, F.initcap(known)).when(style == 1, F.when(known == "user", "Human").when(known == "assistant", "AI").otherwise("System")).otherwise(known)
    mark = F.when(style < 2, F.concat(name, F.lit(": "))).when(style == 2, F.concat(F.lit("<|"), name, F.lit("|> "))).when(style == 3, F.concat(F.lit("### "), name, F.lit(": "))).otherwise(F.concat(F.lit("["), name, F.lit("] ")))
    raw = F.concat(F.when(bare, F.lit("\n")).otherwise(mark), F.coalesce("text", F.lit("")))
    return transcripts.rows_of(turns.select("conv_id", "turn", "role", raw.alias("raw")), "conv_id", ["turn"], "raw", ["role"])


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and turns recovered from raw transcripts of all conversations; learned on those of crc32(conv_id) mod 5 other
    than 0. Turns are numbered from 0 along each conversation; rows without a conv_id are conversations by themselves."""
    rows = written(_transcripts(spark, sf_dir))
    model = transcripts.fit(rows.where(F.pmod(F.crc32("conv"), F.lit(5)) != 0))
    found = transcripts.turns_of(transcripts.parse(transcripts.chunks_of(rows), model))
    return found.select(F.col("conv").try_cast("long").alias("conv_id"), F.col("turn").alias("turn_no"), "role", "text", "rendered")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; a null text counts as empty. Of rows that share text and doc_id, all are kept or none. A null
    doc_id is the largest only where its group has no other."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; null and empty texts have the end id alone."""
    return pieces.encode_digest(table(spark, sf_dir, "documents"), PIECES)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; texts without words take 0, a null source is the last one."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_near_vectors, op4_page_text, op5_language_id, op6_token_counts, op7_transcripts, op8_exact_dedup, op9_sentencepiece, op10_mixing)}

ORACLES = {
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
             g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g ON t.x = g.x
    """,
}
