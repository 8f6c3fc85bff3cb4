"""Queries over preference judgements made from turn pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import preference as P
from saltmarsh.plans.core import register, table

#: Pairs of neighbouring turns with winners that follow from their lengths, so that any SQL engine repeats them.
_PAIRS = """
    WITH p AS (
      SELECT a.conv_id || '/' || a.turn AS key, a.conv_id, a.turn, a.text AS "left", b.text AS "right", abs(length(a.text) - length(b.text)) AS gap,
             CASE WHEN length(a.text) > length(b.text) THEN 'left' WHEN length(a.text) < length(b.text) THEN 'right' END AS longer_side,
             CASE WHEN abs(length(a.text) - length(b.text)) < 60 THEN 'near' WHEN abs(length(a.text) - length(b.text)) < 200 THEN 'mid' ELSE 'far' END AS bin,
             CASE (length(a.text) + 2 * length(b.text)) % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'left' WHEN 2 THEN 'left' ELSE 'right' END AS winner,
             CASE WHEN (a.conv_id + a.turn) % 2 = 0 THEN 'left' ELSE 'right' END AS second_side
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    a = turns.select("conv_id", "turn", F.col("text").alias("left"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right"))
    la, lb = F.length("left"), F.length("right")
    gap = F.abs(la - lb)
    coin = (la + 2 * lb) % 5
    return a.join(b, ["conv_id", "turn"]).select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        "conv_id",
        "turn",
        "left",
        "right",
        gap.alias("gap"),
        F.when(la > lb, "left").when(la < lb, "right").alias("longer_side"),
        F.when(gap < 60, "near").when(gap < 200, "mid").otherwise("far").alias("bin"),
        F.when(coin == 0, "tie").when(coin.isin(1, 2), "left").otherwise("right").alias("winner"),
        F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "left").otherwise("right").alias("second_side"),
    )


def second_round(first):
    """The swapped pairs, judged by a rule that flips some."""
    again = F.when(F.length("left") % 7 == 0, "tie").when((F.length("left") + F.length("right")) % 4 == 0, "left").otherwise("right")
    return P.swapped(first).withColumn("winner", again)


_SECOND = """, q AS (
      SELECT key AS of_key, "right" AS "left", "left" AS "right",
             CASE WHEN length("right") % 7 = 0 THEN 'tie' WHEN (length("left") + length("right")) % 4 = 0 THEN 'left' ELSE 'right' END AS winner FROM p),
    m AS (SELECT p.key, p.bin, p.winner AS w1, q.winner AS w2, CASE p.winner WHEN 'left' THEN p."left" WHEN 'right' THEN p."right" END AS t1,
                 CASE q.winner WHEN 'left' THEN q."left" WHEN 'right' THEN q."right" END AS t2 FROM q JOIN p ON q.of_key = p.key)"""


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


@register(
    "seat_tally",
    f"""{_PAIRS},
    c AS (SELECT count(*) AS n_pairs, count(*) FILTER (winner = 'tie') AS tie, count(*) FILTER (winner <> 'tie') AS d, count(*) FILTER (winner = second_side) AS w,
                 count(*) FILTER (winner = 'right') AS r, count(*) FILTER (winner <> 'tie' AND second_side = 'left') AS nl,
                 count(*) FILTER (winner = 'left' AND second_side = 'left') AS wl, count(*) FILTER (winner = 'right' AND second_side = 'right') AS wr FROM p),
    s AS (SELECT *, w::DOUBLE / d AS share, 1.96 * sqrt(0.25 / d) AS noise, wl::DOUBLE / nl AS a, wr::DOUBLE / (d - nl) AS b, nl::DOUBLE / d AS ls FROM c)
    SELECT n_pairs, tie, d AS n_decided, w AS second_wins, round(share, 9) AS second_share, round(noise, 9) AS noise, round(r::DOUBLE / d, 9) AS position_right_share,
           round((a - b) / 2, 9) AS side_bias, round(ls, 9) AS left_seat_share, round((a - b) / 2 * (2 * ls - 1), 9) AS residual_bias, round((a + b) / 2, 9) AS seat_balanced_share,
           CASE WHEN share - 0.5 > noise THEN 'won' WHEN 0.5 - share > noise THEN 'lost' ELSE 'not won' END AS verdict FROM s""",
)
def seat_tally(spark, sf_dir):
    names = ("second_share", "noise", "position_right_share", "side_bias", "left_seat_share", "residual_bias", "seat_balanced_share")
    return _rounded(P.tally(pairs(spark, sf_dir)), *names)


_BINS = """
    b AS (SELECT bin, count(*) FILTER (gap <> 0) AS n, count(*) FILTER (gap = 0) AS same, count(*) FILTER (gap <> 0 AND winner <> 'tie') AS d,
                 count(*) FILTER (gap <> 0 AND winner = longer_side) AS w, count(*) FILTER (gap <> 0 AND longer_side = 'left') AS l, list_sort(list(gap) FILTER (gap <> 0)) AS g FROM p GROUP BY bin)"""


@register(
    "bin_tally",
    f"""{_PAIRS},{_BINS}
    SELECT bin, n, same AS same_length_dropped, n - d AS tie, round((n - d)::DOUBLE / n, 9) AS tie_rate, d AS n_decided, g[1 + (len(g) // 2)::INT]::BIGINT AS gap_median, w AS longer_wins,
           round(w::DOUBLE / d, 9) AS longer_share, round(3 * sqrt(0.25 / d), 9) AS noise, round(3 * sqrt(0.25 / n), 9) AS noise_at_bin_size, round(l::DOUBLE / n, 9) AS longer_on_left_share FROM b""",
)
def bin_tally(spark, sf_dir):
    out = P.bin_tally(pairs(spark, sf_dir)).withColumn("gap_median", F.col("gap_median").cast("long"))
    return _rounded(out, "tie_rate", "longer_share", "noise", "noise_at_bin_size", "longer_on_left_share")


@register(
    "bin_verdict",
    f"""{_PAIRS},{_BINS},
    s AS (SELECT bin, w::DOUBLE / d AS share, 3 * sqrt(0.25 / d) AS noise, 3 * sqrt(0.25 / n) AS planned FROM b),
    v AS (SELECT count(*) AS n, count(*) FILTER (abs(share - 0.5) <= noise) AS w, bool_or((abs(share - 0.5) <= noise) <> (abs(share - 0.5) <= planned)) AS f,
                 max(share) FILTER (bin = 'near') AS near, max(share) FILTER (bin = 'far') AS far, max(noise) FILTER (bin = 'near') + max(noise) FILTER (bin = 'far') AS ns FROM s)
    SELECT CASE WHEN far IS NULL OR near IS NULL THEN 'L3' WHEN far >= 0.60 AND far - near > ns THEN 'L1' WHEN w = n THEN 'L2' ELSE 'L3' END AS line, w AS n_within, f AS floor_sensitive,
           round(near, 9) AS near, round(far, 9) AS far, round(ns, 9) AS noise_sum FROM v""",
)
def bin_verdict(spark, sf_dir):
    return _rounded(P.bin_verdict(P.bin_tally(pairs(spark, sf_dir))), "near", "far", "noise_sum")


@register(
    "flip_rate",
    f"""{_PAIRS}{_SECOND}
    SELECT bin, count(*) AS n, count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL) AS decided_twice, count(*) FILTER (t1 <> t2) AS flips,
           count(*) FILTER (t1 IS NOT NULL AND t2 IS NULL) AS decided_tie, count(*) FILTER (t1 IS NULL AND t2 IS NOT NULL) AS tie_decided, count(*) FILTER (t1 IS NULL AND t2 IS NULL) AS tie_tie,
           round(count(*) FILTER (t1 <> t2)::DOUBLE / nullif(count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL), 0), 9) AS flip_rate,
           round(3 * sqrt(0.25 / nullif(count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL), 0)), 9) AS noise,
           round(least(1.0::DOUBLE, 2 * count(*) FILTER (t1 <> t2)::DOUBLE / nullif(count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL), 0)), 9) AS coin_toss_share
    FROM m GROUP BY bin""",
)
def flip_rate(spark, sf_dir):
    first = pairs(spark, sf_dir)
    return _rounded(P.flip_rates(P.matched_rounds(first, second_round(first))), "flip_rate", "noise", "coin_toss_share")


@register(
    "flip_shape",
    f"""{_PAIRS}{_SECOND},
    c AS (SELECT count(*) FILTER (t1 <> t2 AND w1 = 'left' AND w2 = 'left') AS l, count(*) FILTER (t1 <> t2 AND w1 = 'right' AND w2 = 'right') AS r FROM m)
    SELECT l + r AS flips, l AS left_twice, r AS right_twice, round(l::DOUBLE / (l + r), 9) AS left_share, round(3 * sqrt(0.25 / (l + r)), 9) AS noise,
           CASE WHEN l + r = 0 THEN 'no flips' WHEN abs(l::DOUBLE / (l + r) - 0.5) > 3 * sqrt(0.25 / (l + r)) THEN 'seat preference' ELSE 'symmetric' END AS reads_as,
           CASE WHEN l + r = 0 THEN 'no flips' WHEN abs(l::DOUBLE / (l + r) - 0.5) > 1.96 * sqrt(0.25 / (l + r)) THEN 'seat preference' ELSE 'symmetric' END AS at_1_96_sigma FROM c""",
)
def flip_shape(spark, sf_dir):
    first = pairs(spark, sf_dir)
    return _rounded(P.flip_shape(P.matched_rounds(first, second_round(first))), "left_share", "noise")


@register(
    "repeat_verdict",
    f"""{_PAIRS}{_SECOND},
    r AS (SELECT bin, count(*) FILTER (t1 <> t2)::DOUBLE / nullif(count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL), 0) AS f FROM m GROUP BY bin),
    v AS (SELECT max(f) AS w, max(f) FILTER (bin = 'near') AS a, max(f) FILTER (bin = 'mid') AS b, max(f) FILTER (bin = 'far') AS c FROM r)
    SELECT CASE WHEN w IS NULL THEN 'R3' WHEN w <= 0.10 THEN 'R1' WHEN w >= 0.30 THEN 'R2' ELSE 'R3' END AS line, round(w, 9) AS worst, a >= b AND b >= c AS prediction_held FROM v""",
)
def repeat_verdict(spark, sf_dir):
    first = pairs(spark, sf_dir)
    return _rounded(P.repeat_verdict(P.flip_rates(P.matched_rounds(first, second_round(first)))), "worst")


@register(
    "preference_triples",
    f"""{_PAIRS} SELECT key, md5(CASE winner WHEN 'left' THEN "left" ELSE "right" END) AS chosen, md5(CASE winner WHEN 'left' THEN "right" ELSE "left" END) AS rejected FROM p WHERE winner <> 'tie'""",
)
def preference_triples(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("prompt", F.col("key"))
    made = P.triples(rows, rows.select("key", "winner"))
    return made.select("key", F.md5(F.col("chosen").cast("binary")).alias("chosen"), F.md5(F.col("rejected").cast("binary")).alias("rejected"))


@register(
    "preference_length_drift",
    f"""{_PAIRS}, g AS (SELECT CASE winner WHEN 'left' THEN length("left") - length("right") ELSE length("right") - length("left") END AS g FROM p WHERE winner <> 'tie')
    SELECT count(*) AS n, round(avg(g), 6) AS mean_gap, round(avg((g > 0)::INT::DOUBLE), 9) AS longer_share FROM g""",
)
def preference_length_drift(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("prompt", F.col("key"))
    return P.length_drift(P.triples(rows, rows.select("key", "winner"))).select("n", F.round("mean_gap", 6).alias("mean_gap"), F.round("longer_share", 9).alias("longer_share"))


@register("seat_coin", "SELECT item_id, CASE WHEN ('0x' || substr(md5('3:' || item_id), 1, 8))::BIGINT % 2 = 0 THEN 'left' ELSE 'right' END AS seat FROM benchmark")
def seat_coin(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.seat(3, F.col("item_id")).alias("seat"))
