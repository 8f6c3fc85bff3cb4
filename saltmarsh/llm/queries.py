"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import functools

from saltmarsh.llm import ann_queries, decontaminate_queries, language_queries, mixing_queries, secret_queries, simhash_queries, suffix_queries, token_queries, toxicity_queries, url_queries
from saltmarsh.session import bounded_batches


def _bounded(query):
    """The query, in a session whose Arrow batches are small, so that long texts do not fill the executors."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_suffix_dedup": suffix_queries.op1_suffix_dedup,
    "op2_secrets": secret_queries.op2_secrets,
    "op3_decontamination": decontaminate_queries.op3_decontamination,
    "op4_token_output": token_queries.op4_token_output,
    "op5_simhash": simhash_queries.op5_simhash,
    "op6_language_id": language_queries.op6_language_id,
    "op7_toxicity": toxicity_queries.op7_toxicity,
    "op8_mixing": mixing_queries.op8_mixing,
    "op9_url_filter": url_queries.op9_url_filter,
    "op10_ann": ann_queries.op10_ann,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}
ORACLES = {
    "op3_decontamination": decontaminate_queries.OP3_SQL,
    "op8_mixing": mixing_queries.OP8_SQL,
}
