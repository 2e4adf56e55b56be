"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the
shared folder and hands what it reads back to the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard_join, language_id, mixing, packing, quality
from loam.llm.common import Workspace

#: No SQL: two stages apply trained models. tests/llm/test_models.py tests the stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls clean; those without a word go."""
    return quality.clean_only(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's labels teach; those without a letter, in doubt or unlike what was learned go."""
    labelled = docs.where(language_id.fold(F.col("doc_id")) != 2).select("lang", "text")
    return language_id.identified(docs, language_id.train(labelled))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, Jaccard 0.8), that with the least doc_id."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length in tokens, bucket, bucket_length, batch, slot and padding of every document."""
    return packing.packed_by_tokens(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for _, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir))
    return docs
