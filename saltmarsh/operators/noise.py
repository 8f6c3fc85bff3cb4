"""Babble: clips with the voices of other clips behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.audio import mixed, pcm, samples
from saltmarsh.operators.corpus import hash_rank, numbered

#: Voices of one babble.
VOICES = 6


def excerpts(sources: list[bytes], marks: list[int], length: int) -> bytes:
    """The sum of one stretch of each source; its mark says where it starts, and short sources go round."""
    total = np.zeros(length)
    for body, mark in zip(sources, marks):
        x = samples(body).astype(float)
        if len(x):
            start = mark % max(1, len(x) - length + 1)
            total += np.resize(x[start : start + length], length)
    top = np.abs(total).max(initial=0.0)
    return pcm(total * (32767 / top) if top > 32767 else total)  # only its shape counts, as its level is set later


def babbled(clips: DataFrame, key: str, body: str, db: float, voices: int = VOICES, seed: int = 0) -> DataFrame:
    """The clips (PCM16) with ``voices`` excerpts of clips behind each, ``db`` below it, scaled down where it would clip.

    The sources of a clip follow from a hash of its key: places in the hashed order of all clips, so they are
    the same in every run, and each place is joined by its number. A clip meets its few sources only. Keys are
    distinct. Null clips stay null and are no sources; empty ones stay empty.
    """
    heard = clips.where(F.col(body).isNotNull())
    rank = hash_rank(F.lit(seed), F.col(key))
    placed = numbered(heard.select(F.col(key).alias("k_"), F.col(body).alias("source_")).withColumn(key, F.col("k_")), rank, key, "at_", bucket=F.substring(rank, 1, 2)).select("at_", "source_")
    n = heard.agg(F.count("*").alias("n_"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(voices - 1)))
    asked = heard.select(key).join(F.broadcast(n)).select(key, "n_", turn.alias("turn_"))  # one row is broadcast
    drawn = asked.select(key, "turn_", F.pmod(F.xxhash64(key, "turn_", F.lit(seed)), F.col("n_")).alias("at_"), F.pmod(F.xxhash64(F.lit("start"), key, "turn_", F.lit(seed)), F.lit(1 << 40)).alias("mark_"))
    # At most ``voices`` sources a clip.
    sources = drawn.join(placed, "at_").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_", "mark_", "source_"))).alias("sources_"))

    def run(bodies: pd.Series, marks: pd.Series, others: pd.Series) -> pd.Series:
        def one(clip, at, behind):
            if clip is None or behind is None:
                return clip
            length = len(samples(clip))
            return mixed(clip, excerpts(list(behind), [int(m) for m in at], length), db) if length else clip

        return pd.Series([one(*row) for row in zip(bodies, marks, others)], dtype=object)

    mix = F.pandas_udf(run, "binary")
    columns = [c if c != body else mix(F.col(body), F.col("sources_.mark_"), F.col("sources_.source_")).alias(body) for c in clips.columns]
    return clips.join(sources, key, "left").select(*columns)
