"""The query of the SimHash operator. SQL has no XXH64: it is tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.llm.simhash import simhash_groups


def op5_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(docs).select("doc_id", fp.alias("fingerprint"), "component_id")
