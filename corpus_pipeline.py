"""The corpus pipeline: language ID, near-duplicate removal, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() applies them to the documents table and stores what each returns before the next reads it.

Defined cases, in every stage: a null text has no language and goes with the first stage, as does one without a letter;
an empty table passes through; texts are whole, however long. Rows with equal or null ids are rows of their own: of a
group of near copies the row with the smallest id stays (nulls last, then by text), and of repeated rows one. Ties of
sizes are broken by seeded hashes, so reruns agree. Columns besides those of documents are kept up to the last stage,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkbasin.llm.common import stored, table
from inkbasin.llm.op2_crossparse import keep_language
from inkbasin.llm.op4_apportion import mixed_documents
from inkbasin.llm.op7_packing import pack
from inkbasin.llm.op8_surrogates import private_documents
from inkbasin.llm.op10_sigtree import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; null languages are filled in."""
    return keep_language(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(spark, docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return private_documents(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document, repeats included; others go."""
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither automata, seeded hashes nor tokenizers; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
