"""Corpus pipeline: five stages over documents, each on all that its predecessor kept.

Toxic documents go; of equal texts one stays; of near-duplicate groups (five-word shingles,
similarity 0.8 or more) one document stays; documents that hold a benchmark item go; the rest is
packed into sequences of 4096 tokens. The first four stages return the columns of documents.

Defined cases: rows are judged by their own texts, so null and repeated doc_ids lose no row but that a
near copy without doc_id stays; a null text counts as empty: one such row passes all filters; empty
texts link with nothing; very long texts are read whole; other columns pass through the first four
stages, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrel.llm import decontaminate, exact_dedup, jaccard, packing, toxicity
from quadrel.llm.common import collect_garbage, load, materialise

SHINGLE_WORDS, SIMILARITY = 5, "0.8"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    """stage, before which the executors give back the memory that the one before took."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", rested(drop_toxic)),
    ("exact_dedup", rested(drop_copies)),
    ("jaccard_join", rested(drop_near_copies)),
    ("decontamination", rested(drop_benchmark)),
    ("packing", rested(pack)),
]

#: The stages learn, hash and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
