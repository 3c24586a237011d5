"""The corpus pipeline: five stages over ``documents``, each a table of its own.

language_id    texts without a letter, and those the models are at a loss with, go
simhash_dedup  one document of each group of near copies stays, the smallest id
secret_scan    every span found is replaced by a mark
mixing         documents repeat, or shrink to the stretch drawn, by source targets
packing        pieces of at most 1024 tokens, placed in sequences

A stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, but for
the last, which returns the pieces.  Nulls, empty texts, repeated rows, empty
tables and extra columns are handled as the operators state; ``n_chars``, where
there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import language_id, mixing, packing, secret_scan, simhash_dedup
from quiver.llm._common import box, materialize, table, unbox
from quiver.llm.queries import tokenizer_path

#: Language scores below this are rejected.
MIN_SCORE = 0.2


def lengths(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, made to follow the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out()))
    judged = language_id.predict(box(docs, "text"), model)
    return unbox(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = simhash_dedup.simhash_dedup(box(docs, "text", "doc_id"), ["_box", "text", "doc_id"])
    return unbox(kept, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lengths(secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lengths(mixing.mix_texts(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and tokens cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
