"""A training-corpus pipeline: five operators in a row over the whole documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents, so any stage may be left out or run alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import decontaminate, jaccard, pii, quality, sentencepiece_fst
from oreline.llm.queries import may_learn, table
from oreline.llm.shared import saved, small_batches

NEAR_SHINGLE = 5
NEAR_PERCENT = 80
#: Texts of an Arrow batch: workers of several stages live side by side in an executor.
BATCH_ROWS = 500


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark, BATCH_ROWS)
    model = quality.fit(docs, may_learn(table(spark, sf_dir, "labels")))
    return quality.keep_accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 80 % of their runs of five words."""
    small_batches(spark, BATCH_ROWS)
    return jaccard.keep_one(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    small_batches(spark, BATCH_ROWS)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.mask(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    small_batches(spark, BATCH_ROWS)
    return sentencepiece_fst.encode_column(docs)


STAGES = [("quality", accepted), ("near_copies", distinct), ("decontamination", uncontaminated), ("personal_data", masked), ("tokens", tokenised)]
#: Classifiers, suffix arrays and tokenizers have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
