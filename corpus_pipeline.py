"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; ``run`` writes it as Parquet to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import decontaminate, pieces, simhash, substrings, toxicity
from trajecta.llm.common import clean, saved, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cleaned(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL has neither the trees nor the hashes nor the vocabulary of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote for itself, and its input, go when it is done. An
    empty table gives an empty result."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        clean(spark, since=before, keep=1)
    return docs
