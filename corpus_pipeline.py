"""A corpus pipeline of the operators in lexigrove.llm.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import byte_bpe, language_id, mixing
from lexigrove.llm.common import documents, in_written_order, materialise
from lexigrove.llm.exact_dedup import drop_copies
from lexigrove.llm.ngram_join import one_of_each
from lexigrove.llm.queries import byte_vocabulary, piece_vocabulary


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which the language is in doubt, go."""
    return language_id.keep_identified(docs, piece_vocabulary())


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, one stays."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of 5-word shingles, the first stays."""
    return one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, sources by their natural shares: what encoded() goes by."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document, in the order of the mix, along which
    mix_order rises (with gaps)."""
    return byte_bpe.tokens(in_written_order(docs, "mix_order"), *byte_vocabulary(), order_col="mix_order")


STAGES = [
    ("language_id", told_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("pfair_mixing", mixed_sources),
    ("byte_bpe", encoded),
]
#: Tokenising and language models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
