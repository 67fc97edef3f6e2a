"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents,
and other columns of ``docs`` whatever their names. Nulls, empty and very long texts, ties, repeated rows and empty
tables are handled by the operator that a stage calls, as its docstring says; each stage's gives what that means here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphtension.llm import jaccard, language, mixing, packing, substrings
from graphtension.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter or in no such language go.

    Null and empty texts go; rows without a lang are judged but teach nothing; repeated rows are judged alike.
    """
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 over five-word shingles connect.

    The smallest id of a group stays; repeated rows of it stay all. Null and empty texts are groups of their own.
    """
    return jaccard.one_of_each(docs, 5, 80, 100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has; emptied documents go.

    Null and empty texts stay as they are; repeated rows lose nothing to each other.
    """
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, documents repeated or left out.

    Null sources are one source, the last; null and empty texts weigh nothing and go at their source's rate.
    """
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; a null or empty text is the end id alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Learned languages and a tokenizer are beyond SQL; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
