"""The training-data pipeline: five stages, each over all rows the one before kept."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from corpuslint.llm import op2_mixing, op5_toxicity, op6_pseudonyms, op8_packing, op10_ngram_join  # noqa: E402
from corpuslint.llm.common import documents, table  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return op5_toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard from 0.8 on, of shingles of five words."""
    return op10_ngram_join.one_of_each(docs, words=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in place of personal data."""
    return op6_pseudonyms.pseudonymised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, one row for each pass over a document."""
    return op2_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return op8_packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
    ("packing", packing),
]

#: Models, graph components and dynamic programming: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
