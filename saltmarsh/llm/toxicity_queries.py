"""The query of the toxicity operator. SQL cannot fit a machine: it is tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.llm.toxicity import THRESHOLD, held_out, score, train


def op7_toxicity(spark, sf_dir):
    """A score for every document, learned from the labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
