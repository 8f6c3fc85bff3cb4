"""The query of the language operator. SQL cannot iterate EM: it is tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.llm.language_id import held_out, predict, train


def op6_language_id(spark, sf_dir):
    """A language for every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
