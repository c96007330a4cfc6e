"""The corpus pipeline: classify, drop near-duplicates, cut repeats, decontaminate, mix.

Each stage takes documents with their columns, whatever their names, and keeps rows with null columns, empty or very long
texts and shared ids unless its own rule drops them; an empty table stays empty. What counts as what is said at each
operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._session import shared_folder
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import keep_good
from tidemark.llm.simhash import keep_one_of_each
from tidemark.llm.substring_dedup import without_repeats
from tidemark.runtime import drop_folder
from tidemark.sources import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't reject; without labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, documents without id last; of equal rows one stays."""
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated runs of 35 words cover; n_chars follows the text; no row is dropped."""
    return without_repeats(docs, window=35)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark passage; empty texts leak none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes, none included; ties of rank go by id and text."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the classifier, so the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written as Parquet to the shared folder and read again.

    A stage's result is deleted once the next one's is written; the last one's input stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
