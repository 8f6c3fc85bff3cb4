"""Choosing rows: allow lists, length limits, shards, samples by group, listings; and joins that account for what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.stats import binomial_noise
from saltmarsh.operators.corpus import hash_rank
from saltmarsh.operators.governance import required


def allowed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose ``key`` is listed; a null key never is."""
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def fitted(rows: DataFrame, text: str, longest: int, rewrite: Column) -> DataFrame:
    """Adds ``outcome``: kept, rewritten (once, where that brings the text within ``longest``) or dropped; a null text is dropped."""
    fits, helps = F.length(text) <= longest, F.length(rewrite) <= longest
    outcome = F.when(fits, "kept").when(helps, "rewritten").otherwise("dropped")
    return rows.withColumn("outcome", outcome).withColumn(text, F.when(F.col("outcome") == "rewritten", rewrite).otherwise(F.col(text)))


def single_row(rows: DataFrame, *order: str) -> DataFrame:
    """One row of the same schema, the first in ``order``."""
    return rows.orderBy(*order).limit(1)


def in_shard(rows: DataFrame, group: str, shards: int, index: int) -> DataFrame:
    """The rows of one of ``shards`` workers, which take the groups in turn."""
    return rows.where(F.pmod(F.col(group), F.lit(shards)) == index)


def _ranked(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(hash_rank(F.lit(seed), F.col(key)), key)))


def picked(rows: DataFrame, group: str, key: str, wanted: int, seed: str = "pick") -> DataFrame:
    """``wanted`` rows, an equal share of one more than needed from each group, in order of groups."""
    groups = rows.agg(F.count_distinct(group).alias("groups_"))
    share = F.greatest(F.lit(1), F.floor(F.lit(wanted) / F.col("groups_")) + 1)
    few = _ranked(rows, group, key, seed).join(F.broadcast(groups)).where(F.col("rank_") <= share)  # one row is broadcast
    return few.orderBy(group, "rank_").limit(wanted).drop("rank_", "groups_")


def spread(rows: DataFrame, batch: str, key: str, sample: int, seed: str = "spread") -> DataFrame:
    """The same number of rows of each batch, ``sample`` over all rounded up."""
    batches = rows.agg(F.count_distinct(batch).alias("batches_"))
    few = _ranked(rows, batch, key, seed).join(F.broadcast(batches))  # one row is broadcast
    return few.where(F.col("rank_") <= F.ceil(F.lit(sample) / F.col("batches_"))).drop("rank_", "batches_")


def two_stage(rows: DataFrame, group: str, key: str, groups: int, each: int, seed: str = "stage") -> DataFrame:
    """``each`` rows of ``groups`` groups, both by hash."""
    chosen = rows.select(group).distinct().orderBy(hash_rank(F.lit(seed), F.col(group)), group).limit(groups)
    return _ranked(rows.join(chosen, group, "left_semi"), group, key, seed).where(F.col("rank_") <= each).drop("rank_")


def most_common(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, count) of the ``k`` commonest, of equals the smaller value."""
    return rows.groupBy(value).agg(F.count("*").alias("count")).orderBy(F.desc("count"), value).limit(k)


def worst(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of the lowest scores, of equals the smaller key; null scores do not count."""
    return rows.where(F.col(score).isNotNull()).orderBy(score, key).limit(k)


def resolved(ratings: DataFrame, positions: DataFrame, name: str, position: str = "position", strict: bool = True) -> DataFrame:
    """Ratings with ``token``: by the map of positions, else what stands before ``#`` in ``name``.

    ``positions`` has (``position``, token). A rating with neither stops the job, unless ``strict`` is off.
    """
    own = F.nullif(F.regexp_extract(F.col(name), r"^([^#]+)#", 1), F.lit(""))
    mapped = positions.select(position, F.col("token").alias("mapped_"))
    out = ratings.join(mapped, position, "left").withColumn("token", F.coalesce("mapped_", own)).drop("mapped_")
    return required(out, F.col("token").isNotNull(), "a rating has no position in the key and no token") if strict else out


def repacked(sheets: DataFrame, rater: str, order: str) -> DataFrame:
    """Adds ``file``: 001 and on, in each rater's order; with ``order`` it is the map back to what was rated."""
    number = F.row_number().over(Window.partitionBy(rater).orderBy(order))
    return sheets.withColumn("file", F.lpad(number.cast("string"), 3, "0"))


def matched(judgements: DataFrame, pairs: DataFrame) -> DataFrame:
    """Judgements beside their pairs, by key or, where that is empty, by id; ``matched`` tells what found none.

    ``judgements`` has (key, id, winner), ``pairs`` (key, ...); the pairs' columns are null where none is found.
    """
    by = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.col("id"))
    told = judgements.select(by.alias("key"), F.col("winner").alias("verdict"))
    return told.join(pairs.withColumn("matched", F.lit(True)), "key", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def heard(samples: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Samples with ``score``; one without audio has none, which is null and never 0."""
    return samples.join(scores.select(key, "score"), key, "left")


def settings_of(runs: DataFrame, generated: str, *settings: str) -> DataFrame:
    """Adds ``generation_settings``, null where nothing was generated."""
    return runs.withColumn("generation_settings", F.when(F.col(generated) > 0, F.struct(*settings)))


def set_digest(rows: DataFrame, content: str, *keys: str) -> DataFrame:
    """(keys, n, digest): SHA-256 of the SHA-256 digests of all contents of a group, sorted; a null content counts as empty."""
    one = F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(one)), "").alias("all_"))
    return sums.select(*keys, "n", F.sha2(F.col("all_").cast("binary"), 256).alias("digest"))


def behavioural_evidence(cases: DataFrame, right: Column, *keys: str) -> DataFrame:
    """(keys, n, ordered, noise, evident): whether the share of right cases is over one half by more than its noise."""
    out = cases.groupBy(*keys).agg(F.count(right).alias("n"), F.avg(right.cast("double")).alias("ordered"))
    noise = binomial_noise(F.col("n"))
    return out.select(*keys, "n", "ordered", noise.alias("noise"), (F.col("ordered") - 0.5 > noise).alias("evident"))
