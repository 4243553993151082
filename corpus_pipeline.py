"""A training corpus from raw documents: five stages, each written and read by the next.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one its
tokens. Each works on all rows that the one before has kept.

Defined results, for every stage: a null text counts as empty, which no language is told for, so
the first stage drops it; rows without an id are judged by their text like others, and at most one
row of a near-duplicate component stays; repeated rows are one component; ties go to the smallest
id; very long texts are read whole; columns beside those of documents are carried, whatever their
names and types; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, decontaminate, langid, simhash, suffix_dedup
from paperloom.llm.queries import ranks_path
from paperloom.llm.tables import release_all_but_last, scope, spool, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin stay."""
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within two bits one row stays, that of the smallest id."""
    return simhash.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; n_chars follows the text."""
    return suffix_dedup.strip_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets and the digests of ids and decoded bytes."""
    return bpe.encode(docs, bpe.read_ranks(ranks_path()), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: The stages embed XXH64, zstandard and BPE, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scope(spark) as made:
        for name, stage in STAGES[:-1]:
            docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
            release_all_but_last(spark, made)  # what the stage has read and made on its way
    return STAGES[-1][1](spark, docs, sf_dir)
