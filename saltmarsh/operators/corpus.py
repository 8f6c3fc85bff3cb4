"""Corpus preparation: turns, conditioning, trimming, packing, sampling, quotas, near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.text import bigram_set, character_set, token_cost


def hash_rank(*parts: Column) -> Column:
    """A hex digest to order by: the same in every run and in any SQL engine with MD5."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def condition_last_user(turns: DataFrame, key: str, order: str, instruction: Column) -> DataFrame:
    """Puts ``instruction`` in front of each conversation's last user turn; without one nothing changes."""
    last = F.max(F.when(F.col("role") == "user", F.col(order))).over(Window.partitionBy(key))
    hit = F.coalesce((F.col("role") == "user") & (F.col(order) == last), F.lit(False))
    return turns.withColumn("text", F.when(hit, F.concat(instruction, F.col("text"))).otherwise(F.col("text")))


def trimmed_context(turns: DataFrame, key: str, order: str, budget: int = 3072 - 512) -> DataFrame:
    """Adds cost and kept: the newest turns whose costs fit the budget, the newest always."""
    costed = turns.withColumn("cost", token_cost(F.col("text")))
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    upto = F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return costed.withColumn("kept", (upto <= max(0, budget)) | (F.row_number().over(newest) == 1))


def running_offsets(rows: DataFrame, order: str, size: str, buckets: int = 64, width: int | None = None) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over all rows before, in two phases.

    Rows are dealt to ranges of ``order``; sums of whole ranges are added to sums within one, so no task sees
    more than a range. ``width`` is a range's extent, by default a ``buckets``-th of what is there.
    """
    if width is None:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    ranged = rows.withColumn("range_", F.floor(F.col(order) / width))
    sums = ranged.groupBy("range_").agg(F.sum(size).alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("range_", before.alias("base_"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside_", inside).join(bases, "range_").withColumn("start", F.col("base_") + F.col("inside_")).drop("range_", "base_", "inside_")


def numbered(rows: DataFrame, order: Column, key: str, out: str, bucket: Column | None = None, buckets: int = 64) -> DataFrame:
    """Adds ``out``: the row's number from 0 in order of ``order``, then ``key``, over the whole table.

    Rows are dealt to buckets that follow the order, numbered in each, and moved on by the sizes of those
    before: no task orders the whole table. ``bucket`` is by default cut at approximate quantiles of a
    numeric ``order``, computed once; a column of hex digits gives its own leading ones.
    """
    if bucket is None:
        cuts = rows.select(order.cast("double").alias("o")).approxQuantile("o", [k / buckets for k in range(1, buckets)], 0.005)
        bucket = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<double>"), lambda x: x < order.cast("double")))
    dealt = rows.withColumn("o_", order).withColumn("bucket_", bucket)
    sizes = dealt.groupBy("bucket_").agg(F.count("*").alias("in_"))
    before = F.coalesce(F.sum("in_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("bucket_").alias("b_"), before.alias("base_"))
    within = F.row_number().over(Window.partitionBy("bucket_").orderBy("o_", key)) - 1
    placed = dealt.withColumn("within_", within).join(bases, F.col("bucket_").eqNullSafe(F.col("b_")))
    return placed.withColumn(out, F.col("within_") + F.col("base_")).drop("o_", "bucket_", "b_", "within_", "base_")


def sized(rows: DataFrame, out: str) -> DataFrame:
    """Adds the number of rows of the table."""
    return rows.join(F.broadcast(rows.agg(F.count("*").alias(out))))


def packed_blocks(rows: DataFrame, order: str, tokens: str, block: int) -> DataFrame:
    """(block, first, last, texts) of full blocks of ``block`` + 1 tokens when each text ends in one more token."""
    placed = running_offsets(rows.withColumn("n_", F.col(tokens) + 1), order, "n_")
    size = block + 1
    total = placed.agg(F.coalesce(F.max(F.col("start") + F.col("n_")), F.lit(0)).alias("total"))
    spread = placed.select(order, F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_") - 1) / size))).alias("block"))
    return (
        spread.groupBy("block")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("texts"))
        .join(F.broadcast(total))
        .where((F.col("block") + 1) * size <= F.col("total"))
        .drop("total")
    )


def theme_quotas(counts: DataFrame, theme: str, n: str, wanted: int) -> DataFrame:
    """Adds quota: ``wanted`` in proportion, half to even, what is left over to the largest (the first of equals)."""
    whole = Window.partitionBy()
    share = F.bround(F.col(n) * wanted / F.sum(n).over(whole)).cast("long")
    first = F.row_number().over(Window.orderBy(F.desc("quota"), theme)) == 1
    shared = counts.withColumn("quota", share)
    left = F.lit(wanted) - F.sum("quota").over(whole)
    return shared.withColumn("quota", F.col("quota") + F.when(first, left).otherwise(F.lit(0)))


def per_group(rows: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` rows of each group, by the order of a hash."""
    order = Window.partitionBy(group).orderBy(hash_rank(F.lit(seed), F.col(key)), key)
    return rows.withColumn("rn_", F.row_number().over(order)).where(F.col("rn_") <= k).drop("rn_")


def window_shuffle(rows: DataFrame, group: str, key: str, buffer_groups: int = 2, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Adds position: groups in hashed order, windows of ``buffer_groups`` of them, rows hashed within a window."""
    mark = F.lit(seed + epoch)
    groups = rows.select(group).distinct()
    number = F.row_number().over(Window.orderBy(hash_rank(mark, F.lit("group"), F.col(group)), group)) - 1
    windows = groups.withColumn("window_", F.floor(number / buffer_groups))
    joined = rows.join(windows, group)
    sizes = joined.groupBy("window_").count()
    base = F.coalesce(F.sum("count").over(Window.orderBy("window_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("window_").orderBy(hash_rank(mark, F.lit("row"), F.col(key)), key)
    placed = joined.withColumn("within_", F.row_number().over(order) - 1)
    return placed.join(sizes.select("window_", base.alias("base_")), "window_").withColumn("position", F.col("base_") + F.col("within_")).drop("base_", "within_").withColumnRenamed("window_", "shuffle_window")


def ceil_strata(rows: DataFrame, order: str, key: str, strata: int = 5) -> DataFrame:
    """Adds stratum: chunks of ceil(n / strata) rows in order, so the last may be short."""
    placed = sized(numbered(rows, F.col(order), key, "at_"), "n_")
    return placed.withColumn("stratum", F.floor(F.col("at_") / F.ceil(F.col("n_") / strata))).drop("at_", "n_")


def rotated(rows: DataFrame, order: str, value: str, shift: int) -> DataFrame:
    """Adds ``swapped``: the value ``shift`` rows on, round the end; nobody keeps the own while n does not divide it."""
    placed = sized(numbered(rows, F.col(order), order, "rn_"), "n_")
    other = placed.select(F.col("rn_").alias("at_"), F.col(value).alias("swapped"))
    return placed.join(other, F.pmod(F.col("rn_") + shift, F.col("n_")) == F.col("at_")).drop("rn_", "n_", "at_")


def held_out_split(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds held_out: the first floor(n * share) rows by the order of a hash."""
    rank = hash_rank(F.lit(seed), F.col(key))
    placed = sized(numbered(rows, rank, key, "at_", bucket=F.substring(rank, 1, 2)), "n_")
    return placed.withColumn("held_out", F.col("at_") < F.floor(F.col("n_") * share)).drop("at_", "n_")


def drawn_pairs(drafts: DataFrame, item: str, draft: str, text: str, k: int, max_gap: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``k`` pairs of an item's drafts, by the order of a hash: (item, left_draft, right_draft, gap)."""
    a = drafts.select(F.col(item), F.col(draft).alias("left_draft"), F.length(text).alias("la_"))
    b = drafts.select(F.col(item), F.col(draft).alias("right_draft"), F.length(text).alias("lb_"))
    pairs = a.join(b, item).where("left_draft < right_draft").withColumn("gap", F.abs(F.col("la_") - F.col("lb_")))
    if max_gap is not None:
        pairs = pairs.where(F.col("gap") <= max_gap)
    order = Window.partitionBy(item).orderBy(hash_rank(F.lit(seed), F.col(item), F.col("left_draft"), F.col("right_draft")))
    return pairs.withColumn("rn_", F.row_number().over(order)).where(F.col("rn_") <= k).drop("rn_", "la_", "lb_")


def near_duplicate_pairs(items: DataFrame, key: str, text: str, bigrams: float = 0.6, characters: float = 0.9) -> DataFrame:
    """(a, b, bigram_jaccard, character_jaccard), a < b, of texts that are alike by either measure.

    Exact: members of both sets are joined as lists, and a set lists only those that a set this alike must
    share one of, the rarest ceil(n - t n) + 1 of its n members (prefix filter). Frequent members are
    therefore hardly ever listed.
    """
    base = items.select(F.col(key).alias("k"), bigram_set(F.col(text)).alias("g"), character_set(F.col(text)).alias("c"))

    def candidates(members: str, least: float) -> DataFrame:
        listed = base.select("k", F.size(members).alias("n"), F.explode(members).alias("m"))
        df = listed.groupBy("m").agg(F.count("*").alias("df"))
        order = Window.partitionBy("k").orderBy("df", "m")
        keep = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
        kept = listed.join(df, "m").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).select("k", "n", "m")
        other = kept.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "m")
        # A set too small or too large to reach the share is no candidate.
        pairs = kept.join(other, "m").where((F.col("k") < F.col("k2")) & (F.least("n", "n2") >= F.greatest("n", "n2") * least - 1e-9))
        return pairs.select(F.col("k").alias("a"), F.col("k2").alias("b"))

    pairs = candidates("g", bigrams).union(candidates("c", characters)).distinct()
    left = base.select(F.col("k").alias("a"), F.col("g").alias("ga"), F.col("c").alias("ca"))
    right = base.select(F.col("k").alias("b"), F.col("g").alias("gb"), F.col("c").alias("cb"))
    from saltmarsh.functions.text import jaccard

    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("bigram_jaccard"), jaccard(F.col("ca"), F.col("cb")).alias("character_jaccard"))
    return scored.where((F.col("bigram_jaccard") >= bigrams) | (F.col("character_jaccard") >= characters))


def greedy_kept(items: list[tuple[str, str]], bigrams: float = 0.6, characters: float = 0.9) -> list[str]:
    """Keys of the texts that a generator keeps, one by one: those unlike every text kept before.

    Sequential by meaning; for the bounded lists that one generation round holds.
    """

    def sets(t: str) -> tuple[set, set]:
        t = "".join(t.split())
        return ({t[k : k + 2] for k in range(len(t) - 1)} if len(t) > 1 else {t} if t else set()), set(t)

    def share(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a | b else 0.0

    kept: list[tuple[str, tuple[set, set]]] = []
    for key, text in items:
        own = sets(text)
        if not any(share(own[0], o[0]) >= bigrams or share(own[1], o[1]) >= characters for _, o in kept):
            kept.append((key, own))
    return [k for k, _ in kept]
