"""Preference judgements: seats, tallies, bins, repeatability, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.stats import binomial_noise

SEATED = ("left", "right")


def seat(seed: int, key: Column) -> Column:
    """left or right by the parity of a hash of seed and key."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(digit % 2 == 0, "left").otherwise("right")


def tally(pairs: DataFrame) -> DataFrame:
    """Second-arm share of the decided pairs, its noise, what a seat preference leaks in, and the verdict.

    ``pairs`` has winner (left, right or anything else for a tie) and second_side. Ties count, but are never split.
    """
    decided = F.col("winner").isin(*SEATED)
    on_left = F.col("second_side") == "left"
    won = F.col("winner") == F.col("second_side")
    out = pairs.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(~F.coalesce(decided, F.lit(False))).alias("tie"),
        F.count_if(decided).alias("n_decided"),
        F.count_if(decided & won).alias("second_wins"),
        F.count_if(decided & (F.col("winner") == "right")).alias("right_wins"),
        F.count_if(decided & on_left).alias("n_left"),
        F.count_if(decided & on_left & won).alias("won_left"),
        F.count_if(decided & ~on_left & won).alias("won_right"),
    )
    share = F.try_divide(F.col("second_wins"), F.col("n_decided"))
    wl = F.try_divide(F.col("won_left"), F.col("n_left"))
    wr = F.try_divide(F.col("won_right"), F.col("n_decided") - F.col("n_left"))
    left_share = F.try_divide(F.col("n_left"), F.col("n_decided"))
    bias = (wl - wr) / 2
    noise = binomial_noise(F.col("n_decided"))
    word = F.when(F.col("n_decided") == 0, "all ties").when(share - 0.5 > noise, "won").when(0.5 - share > noise, "lost").otherwise("not won")
    return out.select(
        "n_pairs",
        "tie",
        "n_decided",
        "second_wins",
        share.alias("second_share"),
        noise.alias("noise"),
        F.try_divide(F.col("right_wins"), F.col("n_decided")).alias("position_right_share"),
        bias.alias("side_bias"),
        left_share.alias("left_seat_share"),
        (bias * (2 * left_share - 1)).alias("residual_bias"),
        ((wl + wr) / 2).alias("seat_balanced_share"),
        word.alias("verdict"),
    )


def bin_tally(pairs: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Per bin, how often the longer draft won; pairs of equal length are dropped and counted."""
    uneven = F.col("gap") != 0
    decided = uneven & F.col("winner").isin(*SEATED)
    n, d = F.count_if(uneven), F.count_if(decided)
    wins = F.count_if(decided & (F.col("winner") == F.col("longer_side")))
    # Of the values from the greatest down, the first that half of them reach: value number n // 2 from below. It counts
    # equal gaps together before they are shuffled, and gaps are whole numbers no longer than a text.
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN gap <> 0 THEN gap END DESC)").cast(dict(pairs.dtypes)["gap"])
    return pairs.groupBy("bin").agg(
        n.alias("n"),
        F.count_if(~uneven).alias("same_length_dropped"),
        (n - d).alias("tie"),
        F.try_divide(n - d, n).alias("tie_rate"),
        d.alias("n_decided"),
        middle.alias("gap_median"),
        wins.alias("longer_wins"),
        F.try_divide(wins, d).alias("longer_share"),
        binomial_noise(F.nullif(d, F.lit(0)), sigma).alias("noise"),
        F.when(d > 0, binomial_noise(n, sigma)).alias("noise_at_bin_size"),
        F.when(d > 0, F.try_divide(F.count_if(uneven & (F.col("longer_side") == "left")), n)).alias("longer_on_left_share"),
    )


def bin_verdict(bins: DataFrame) -> DataFrame:
    """L1 (far bin rewards length), L2 (no bin does) or L3, and whether the choice of floor matters."""
    judged = F.col("longer_share").isNotNull()
    inside = F.coalesce(F.abs(F.col("longer_share") - 0.5) <= F.col("noise"), F.lit(False))
    planned = F.coalesce(F.abs(F.col("longer_share") - 0.5) <= F.col("noise_at_bin_size"), F.lit(False))

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("bin") == name, F.col(c)))

    out = bins.agg(
        F.count("*").alias("n_bins"),
        F.count_if(judged & inside).alias("n_within"),
        F.coalesce(F.bool_or(judged & (inside != planned)), F.lit(False)).alias("floor_sensitive"),
        of("near", "longer_share").alias("near"),
        of("far", "longer_share").alias("far"),
        (of("near", "noise") + of("far", "noise")).alias("noise_sum"),
    )
    far, near = F.col("far"), F.col("near")
    line = (
        F.when(far.isNull() | near.isNull(), "L3")
        .when((far >= 0.60) & (far - near > F.col("noise_sum")), "L1")
        .when(F.col("n_within") == F.col("n_bins"), "L2")
        .otherwise("L3")
    )
    return out.select(line.alias("line"), "n_within", "floor_sensitive", "near", "far", "noise_sum")


def swapped(pairs: DataFrame) -> DataFrame:
    """The second round's pairs: seats exchanged, a key of their own, no winner yet."""
    other = F.when(F.col("longer_side") == "left", "right").when(F.col("longer_side") == "right", "left").otherwise(F.col("longer_side"))
    return pairs.select(
        F.concat("key", F.lit("~swap")).alias("key"),
        F.col("key").alias("of_key"),
        F.col("right").alias("left"),
        F.col("left").alias("right"),
        "bin",
        "gap",
        other.alias("longer_side"),
    )


def _picked(winner: str, left: str, right: str) -> Column:
    return F.when(F.col(winner) == "left", F.col(left)).when(F.col(winner) == "right", F.col(right))


def matched_rounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both rounds side by side by key, with the texts that each picked; what matches nothing has a null key."""
    a = first.select("key", F.coalesce("bin", F.lit("?")).alias("bin"), F.col("winner").alias("w1"), _picked("winner", "left", "right").alias("t1"))
    b = second.select("of_key", F.col("winner").alias("w2"), _picked("winner", "left", "right").alias("t2"))
    return b.join(a, F.col("of_key") == F.col("key"), "left")


def flip_rates(matched: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Per bin: pairs decided twice, flips of the text picked, and where ties went."""
    one, two = F.col("t1").isNotNull(), F.col("t2").isNotNull()
    both = F.count_if(one & two)
    flips = F.count_if(one & two & (F.col("t1") != F.col("t2")))
    rate = F.try_divide(flips, both)
    return matched.where("key IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n"),
        both.alias("decided_twice"),
        flips.alias("flips"),
        F.count_if(one & ~two).alias("decided_tie"),
        F.count_if(~one & two).alias("tie_decided"),
        F.count_if(~one & ~two).alias("tie_tie"),
        rate.alias("flip_rate"),
        binomial_noise(F.nullif(both, F.lit(0)), sigma).alias("noise"),
        F.least(F.lit(1.0), 2 * rate).alias("coin_toss_share"),
    )


def flip_shape(matched: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Whether flips keep to a seat: the share of flips that picked left twice against one half."""
    flipped = (F.col("t1") != F.col("t2")) & (F.col("w1") == F.col("w2"))
    out = matched.agg(F.count_if(flipped & (F.col("w1") == "left")).alias("left_twice"), F.count_if(flipped & (F.col("w1") == "right")).alias("right_twice"))
    n = F.col("left_twice") + F.col("right_twice")
    share = F.try_divide(F.col("left_twice"), n)
    noise = binomial_noise(F.nullif(n, F.lit(0)), sigma)
    return out.select(
        n.alias("flips"),
        "left_twice",
        "right_twice",
        share.alias("left_share"),
        noise.alias("noise"),
        F.when(n == 0, "no flips").when(F.abs(share - 0.5) > noise, "seat preference").otherwise("symmetric").alias("reads_as"),
        F.when(n == 0, "no flips").when(F.abs(share - 0.5) > binomial_noise(n), "seat preference").otherwise("symmetric").alias("at_1_96_sigma"),
    )


def repeat_verdict(rates: DataFrame) -> DataFrame:
    """R1 (all rates up to 0.10), R2 (one from 0.30 on) or R3, and whether near >= mid >= far held."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col("bin") == name, F.col("flip_rate")))

    out = rates.where("flip_rate IS NOT NULL").agg(F.count("*").alias("n"), F.max("flip_rate").alias("worst"), of("near").alias("near"), of("mid").alias("mid"), of("far").alias("far"))
    line = F.when(F.col("n") == 0, "R3").when(F.col("worst") <= 0.10, "R1").when(F.col("worst") >= 0.30, "R2").otherwise("R3")
    present = F.filter(F.array("near", "mid", "far"), lambda x: x.isNotNull())
    falls = present == F.sort_array(present, asc=False)
    return out.select(line.alias("line"), "worst", ((F.size(present) > 1) & falls).alias("prediction_held"))


def triples(pairs: DataFrame, judgements: DataFrame) -> DataFrame:
    """(key, prompt, chosen, rejected) of decided pairs, matched by key or, where the judgement's is empty, by its id."""
    key = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.col("id")) if "id" in judgements.columns else F.col("key")
    by = judgements.select(key.alias("key"), F.col("winner"))
    joined = pairs.drop("winner").join(by, "key")
    left = F.col("winner") == "left"
    return joined.where(F.col("winner").isin(*SEATED)).select(
        "key", "prompt", F.when(left, F.col("left")).otherwise(F.col("right")).alias("chosen"), F.when(left, F.col("right")).otherwise(F.col("left")).alias("rejected")
    )


def length_drift(made: DataFrame) -> DataFrame:
    """What preferring ``chosen`` teaches about length."""
    gap = F.length("chosen") - F.length("rejected")
    return made.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.avg((gap > 0).cast("double")).alias("longer_share"))
