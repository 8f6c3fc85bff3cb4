"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` writes each stage's result to the shared
folder and reads it again as the next one's documents.

No SQL: the stages hash with XXH64, fit a model and tokenize; ``tests/llm/test_queries_and_pipeline.py`` holds
each stage's rows against a plain version on what the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm.decontaminate import clean
from saltmarsh.llm.mixing import mix_rows
from saltmarsh.llm.simhash import keep_one
from saltmarsh.llm.token_queries import write_and_list
from saltmarsh.llm.toxicity import drop_toxic
from saltmarsh.session import bounded_batches, cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    bounded_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays, that of the least id."""
    bounded_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of a benchmark item go."""
    bounded_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, listed by sequence."""
    bounded_batches(spark)
    return write_and_list(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
