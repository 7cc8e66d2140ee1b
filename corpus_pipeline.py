"""From raw documents to packed sequences: toxic and poor documents go, one of each group of near copies stays.

Defined cases: a null or empty text is scored like any other, is nobody's near copy, and is packed as its end id alone;
repeated rows are near copies of each other, one stays; a null doc_id takes part in all stages and gives way to an id
among near copies; an empty table gives no rows; other columns, whatever their names, are kept until packing. Without
labelled rows of both kinds nothing is toxic, without any nothing is poor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm import ngram_join, packing, quality, toxicity
from matloom.llm.common import durable, unused

ORACLE_SQL = None  # trained models and packing plans have no SQL


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is below 0.7."""
    net = toxicity.fit(docs, _labels(spark, sf_dir))
    score = unused(docs, "_toxicity")
    return toxicity.with_toxicity(docs, net, score_col=score).where(F.col(score) < 0.7).drop(score)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality is 0.3 or more."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    score = unused(docs, "_quality")
    return quality.with_quality(docs, model, score_col=score).where(F.col(score) >= 0.3).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents that links of 0.8 over shingles of five words connect, the one with the least id."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near copies", without_near_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
