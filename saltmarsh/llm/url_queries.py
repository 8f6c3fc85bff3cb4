"""The query of the url filter. SQL cannot fit the models: it is tested against brute force."""

from __future__ import annotations

from saltmarsh.llm.url_filter import filter_urls, train


def op9_url_filter(spark, sf_dir):
    """A verdict for every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, train(pages))
