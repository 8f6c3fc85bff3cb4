"""The query of the suffix-array operator. SQL has no byte positions of a text: it is tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.llm.suffix_dedup import suffix_dedup


def op1_suffix_dedup(spark, sf_dir):
    """What stays of every document once repeated strings of 100 bytes are gone."""
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
