"""The query of the token output. SQL has no tokenizer: it is tested by an exact round trip."""

from __future__ import annotations

from saltmarsh.llm.token_output import VOCABULARY, id_width, manifest, training_order, write_shards
from saltmarsh.session import scratch_dir


def write_and_list(docs, vocabulary=VOCABULARY):
    """Write the shards of ``docs`` to the shared folder and list every sequence in them."""
    ordered, _ = training_order(docs, vocabulary=vocabulary)
    with open(vocabulary, "rb") as file:
        width = id_width(file.read())
    return manifest(write_shards(ordered, scratch_dir(docs.sparkSession)), width=width)


def op4_token_output(spark, sf_dir):
    """Every document's ids in training order: slot, shard, place and hash of each sequence written."""
    return write_and_list(spark.read.parquet(f"{sf_dir}/documents.parquet"))
