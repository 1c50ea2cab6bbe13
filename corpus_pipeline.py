"""A training-text pipeline: identify the language, join near copies, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratoloom.lineage import cut
from stratoloom.llm import byte_bpe, jaccard_join, language_id, mixing, secrets
from stratoloom.llm.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null or without a letter); ``lang`` becomes the predicted one."""
    return language_id.keep_identified(docs, language_id.learn(docs.where(~language_id.held_out(docs["doc_id"]))))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest id, of each component of near copies (5-word shingles, 0.8)."""
    return jaccard_join.one_of_each(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document with its secrets replaced by a mark."""
    return secrets.redact_secrets(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to source weights 1, 2, 3 takes it, at most three times."""
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    return byte_bpe.encode(docs, *byte_bpe.public_ranks())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("secret_scan", scan_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Models, exact joins of whole texts and byte-pair merges are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
