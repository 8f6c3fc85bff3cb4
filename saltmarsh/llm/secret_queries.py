"""The query of the secret scan. SQL has no match positions or decoders: it is tested against brute force."""

from __future__ import annotations

from saltmarsh.llm.secrets import scan


def op2_secrets(spark, sf_dir):
    """Counts and spans of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
