"""Corpus pipeline: documents become packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Models
are fitted on bounded samples of the stage's own input; decisions fall on every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyx.llm import language, packing, simhash, suffix_dedup, toxicity
from panelyx.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep_clean(docs, model)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or in which no language reaches a probability of one half."""
    return language.keep_known(docs, language.learn(docs, ~language.held_out()))


#: Bits in which near-duplicates' fingerprints may differ: texts that far apart share about four fifths of their five-word shingles.
NEAR_BITS = 6


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each SimHash class."""
    return simhash.keep_one(docs, NEAR_BITS)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes that lie in a 50-byte string which also starts in a document of a smaller id; n_chars follows."""
    return suffix_dedup.strip_repeats(docs, "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", strip_repeated_passages),
    ("packing", pack_sequences),
]

#: No stage but the id arithmetic of the last is expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
