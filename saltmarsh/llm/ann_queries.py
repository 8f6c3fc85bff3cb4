"""The query of the neighbour search. An approximate answer has no SQL: its recall is tested against brute force."""

from __future__ import annotations

from saltmarsh.llm.ann import search


def op10_ann(spark, sf_dir):
    """The nearest rows of every query row of ``embeddings``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
