"""Corpus pipeline over the table ``documents``: five operators of the subpackage ``llm``, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the cluster's shared folder
and reads it again as the next stage's documents. All but the last return the columns of ``documents``. The packed pieces
cannot be expressed in SQL (a tokenizer, a trained model and hashed signatures are among the stages), so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontaminate, language_id, line_dedup, minhash, packing
from watchloom.llm.store import Store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language, go; ``lang`` becomes the language found."""
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay in the last of them only."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    return minhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stands in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens, a row for each piece with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
