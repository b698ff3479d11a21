"""A corpus cleaned, freed of near duplicates and packed: stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import language_id, ngram_join, packing, toxicity
from vigilake.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus labels teach; those without letters or of no clear language go."""
    return language_id.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an offending sentence, by the model of the labels table."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each component of 0.8 similar ones."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 4096 tokens."""
    return packing.digests(packing.pack(docs))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Trained models decide the first two stages; SQL cannot express them. tests/llm/test_methods.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
