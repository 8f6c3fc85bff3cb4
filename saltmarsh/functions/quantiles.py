"""Quantiles and medians, one function a convention.

Each convention is a rank, counted from 0, as an expression of the number of values. It picks from an array
``x`` of a few values, or, by ``at_ranks``, from groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.session import cut


def _at(x: Column, index: Column) -> Column:
    return F.try_element_at(F.array_sort(x), (index + 1).cast("int"))


def capped_rank(n: Column, f: float) -> Column:
    """int(f * n), the last at most."""
    return F.least(F.floor(F.lit(f) * n), n - 1)


def minus_one_rank(n: Column, f: float) -> Column:
    """int(f * n) - 1, the first at least."""
    return F.greatest(F.floor(F.lit(f) * n) - 1, F.lit(0))


def percent_rank(n: Column, percent: int) -> Column:
    """n * percent // 100, the last at most."""
    return F.least(F.floor(n * F.lit(percent) / 100), n - 1)


def uncapped_rank(n: Column, f: float) -> Column:
    """int(f * n), which may be past the end."""
    return F.floor(F.lit(f) * n)


def upper_rank(n: Column) -> Column:
    """n // 2: no average of two."""
    return F.floor(n / 2)


def index_capped(x: Column, f: float) -> Column:
    return _at(x, capped_rank(F.size(x), f))


def minus_one(x: Column, f: float) -> Column:
    return _at(x, minus_one_rank(F.size(x), f))


def percent_capped(x: Column, percent: int) -> Column:
    return _at(x, percent_rank(F.size(x), percent))


def index_uncapped(x: Column, f: float) -> Column:
    return _at(x, uncapped_rank(F.size(x), f))


def linear(value: str, f: float) -> Column:
    """The interpolated quantile, an aggregate."""
    return F.percentile(value, F.lit(f))


def upper_median(x: Column) -> Column:
    return _at(x, upper_rank(F.size(x)))


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column], buckets: int = 256) -> DataFrame:
    """(group, n, one column a rank) of the values that are not null; null where a rank is past the end.

    ``ranks`` are expressions of the column ``n``. Exact at any size of a group: approximate quantiles cut each
    group into ``buckets``, whose counts tell which of them a rank falls into, and only the values of these are put
    in order, equal ones as one. No group is gathered. The cuts need not be exact, as counts follow from them,
    but must be the same in every pass, so they are written; ``rows`` must give the same values in every pass too.
    A null group is a group.
    """
    slim = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g_"), F.col(value).alias("v_"))
    inner = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = cut(slim.groupBy("g_").agg(F.count("*").alias("n"), F.array_distinct(F.percentile_approx("v_", inner, 10 * buckets)).alias("cuts_")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    # Cuts ascend: those below a value are counted among each sixteenth first, then among the fifteen after these.
    groups = cuts.select(F.col("g_").alias("h_"), "cuts_", F.filter("cuts_", lambda c, i: i % 16 == 15).alias("coarse_"))
    ahead = F.size(F.filter("coarse_", lambda c: c < F.col("v_"))) * 16
    bucket = ahead + F.size(F.filter(F.slice("cuts_", ahead + 1, F.lit(15)), lambda c: c < F.col("v_")))
    dealt = slim.join(groups, F.col("g_").eqNullSafe(F.col("h_"))).select("g_", bucket.alias("b_"), "v_")
    sizes = dealt.groupBy("g_", "b_").agg(F.count("*").alias("k_"))
    before = F.sum("k_").over(Window.partitionBy("g_").orderBy("b_")) - F.col("k_")
    asked = cuts.select(F.col("g_").alias("h_"), F.explode(wanted).alias("w_")).select("h_", "w_.name", "w_.rank")
    inside = F.col("g_").eqNullSafe(F.col("h_")) & (F.col("rank") >= F.col("base_")) & (F.col("rank") < F.col("base_") + F.col("k_"))
    places = sizes.withColumn("base_", before).join(asked, inside).select("h_", F.col("b_").alias("c_"), "name", (F.col("rank") - F.col("base_")).alias("at_"))
    open_ = places.select("h_", "c_").distinct()
    values = dealt.join(open_, F.col("g_").eqNullSafe(F.col("h_")) & (F.col("b_") == F.col("c_")), "left_semi").groupBy("g_", "b_", "v_").agg(F.count("*").alias("m_"))
    upto = values.withColumn("upto_", F.sum("m_").over(Window.partitionBy("g_", "b_").orderBy("v_")))
    here = F.col("g_").eqNullSafe(F.col("h_")) & (F.col("b_") == F.col("c_")) & (F.col("at_") < F.col("upto_")) & (F.col("at_") >= F.col("upto_") - F.col("m_"))
    found = upto.join(places, here).groupBy("h_").agg(*[F.max(F.when(F.col("name") == name, F.col("v_"))).alias(name) for name in ranks])
    return cuts.select("g_", "n").join(found, F.col("g_").eqNullSafe(F.col("h_")), "left").select(F.col("g_").alias(group), "n", *ranks)
