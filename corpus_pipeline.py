"""A corpus pipeline of five stages, each an operator of chorale.llm over all that the stage before kept.

Language ID drops documents whose language can't be told, exact and near deduplication keep one document of each group,
decontamination drops documents that hold a whole window of a benchmark item (or are covered by shorter items to a twentieth), and
mixing gives every document that is left its place in the training order. Each stage is written as Parquet in the shared folder and read again as the next one's documents. SQL can express neither the
trained classifier nor SimHash, so ORACLE_SQL is None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorale.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from chorale.llm.util import documents, table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier can't tell the language of; whichever language the others are in, they stay."""
    return language_id.keep_known(docs)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
