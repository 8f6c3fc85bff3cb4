"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A source's target is a share of all words. Each of its documents is taken ``floor(target / size)`` whole
times; what is then missing is drawn without replacement: a document with inclusion probability p and a
uniform number u ranks by (u / (1 - u)) / (p / (1 - p)), and documents are taken in rank order until the
words missing are reached (the document that straddles the line is in where at least half of it fits).

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a source
without words has target 0; repeated rows are separate documents, ranked in any order among themselves; rows
without an id are told apart by their text;
an empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm._text import safe_name
from saltmarsh.session import cut, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_REPEAT = 3
#: Bins of one level of the search for a source's cut; two levels leave a millionth of its rows to rank.
BINS = 1024
SEED = "mix-1"


def _key(source: Column) -> Column:
    """A join key that keeps a null source apart and sorts as the names do, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the seed and the id, of rows without an id on their text, alone."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.sha2(text.cast("binary"), 256)), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.lit(seed + ":"), name).cast("binary"), 256), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target).

    Capping at ``max_repeat`` times the size and sharing the excess again by weight ends where every source
    that is not capped has the same words per weight; the capped are those with the least room per weight.
    """
    order = Window.orderBy("skey")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("skey", "source_size", weight.alias("w")).withColumn("room", F.lit(max_repeat) * F.col("source_size") / F.col("w"))
    by_room = Window.orderBy("room", "skey")
    every = Window.partitionBy()
    level = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.sum("w").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("w_before"),
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("w").over(every).alias("all_w"),
    ).withColumn("level", (F.col("all_size") - F.lit(max_repeat) * F.col("before")) / (F.col("all_w") - F.col("w_before")))
    capped = F.col("room") <= F.col("level")
    shared = F.min(F.when(~capped, F.struct(F.col("room"), F.col("skey"), F.col("level")))).over(every)["level"]
    target = F.when(capped, (F.lit(max_repeat) * F.col("source_size")).cast("double")).otherwise(F.col("w") * shared)
    return level.select("skey", "source_size", target.alias("target"))


def _crossing(rows: DataFrame, by: str) -> DataFrame:
    """For each source the first bin whose end lies past the words missing, and the words before it."""
    order = Window.partitionBy("skey").orderBy(by)
    binned = rows.groupBy("skey", by).agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    return (
        binned.withColumn("upto", F.sum("words").over(order))
        .where(F.col("upto") > F.col("missing"))
        .groupBy("skey")
        .agg(F.min(F.struct(F.col(by), (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        .select("skey", F.col(f"at.{by}").alias(f"cut_{by}"), F.col("at.before").alias(f"before_{by}"))
    )


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs``, and its columns ``keep``.

    Short documents have the greater inclusion probability (as 1 / sqrt(1 + words)), so that no few long
    ones fill what a source lacks.
    """
    text = F.col(text_col)
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            _key(F.col(source_col)).alias("skey"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _uniform(F.col(id_col), text, seed).alias("u"),
            *keep,
        )
    )
    lean = F.floor(F.lit(10000.0) / F.sqrt(F.lit(1.0) + F.col("size")))
    totals = base.groupBy("skey").agg(F.sum("size").alias("source_size"), F.sum(lean * F.col("size")).alias("leaning"))
    targets = source_targets(totals.select("skey", "source_size"), weights, max_repeat)
    sources = cut(
        targets.join(totals.select("skey", "leaning"), "skey")
        .withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    p = F.least(F.greatest(F.col("missing") * lean / F.col("leaning"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = F.col("u")
    odds = (u / (1 - u)) * ((1 - p) / p)
    rank = F.when(F.col("leaning") > 0, odds / (1 + odds)).otherwise(F.lit(0.5))
    ranked = base.join(sources, "skey").withColumn("rank", rank)
    first = ranked.withColumn("b1", F.floor(F.col("rank") * BINS))
    second = first.withColumn("b2", F.floor((F.col("rank") * BINS - F.col("b1")) * BINS))
    cut1 = cut(_crossing(first, "b1"))
    inside = second.join(cut1, "skey").where(F.col("b1") == F.col("cut_b1")).withColumn("missing", F.col("missing") - F.col("before_b1"))
    cuts = cut(cut1.join(_crossing(inside, "b2"), "skey"))
    placed = second.join(cuts, "skey", "left")
    # Only the rows of one bin in BINS * BINS of a source are ranked one by one.
    edge = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    order = Window.partitionBy("skey").orderBy("rank", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_b1") + F.col("before_b2") + F.coalesce(F.sum("size").over(order), F.lit(0))
    straddling = placed.where(edge).withColumn("drawn", (before + F.col("size") / 2 <= F.col("missing")).cast("int"))
    below = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    rest = placed.where(F.coalesce(~edge, F.lit(True))).withColumn("drawn", F.when(F.col("missing") <= 0, 0).otherwise(F.coalesce(below.cast("int"), F.lit(1))))
    return rest.unionByName(straddling).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("drawn")).alias("copies"),
        ((F.col("whole") + F.col("drawn")) * F.col("size")).alias("taken"),
        *keep,
    )


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each row as many times as the mix takes it; columns as given."""
    row = safe_name(docs.columns, "mixed_row_no")
    rows = numbered(docs, row)
    counts = pareto_mix(rows, keep=(row,), **options).select(F.col(row).alias("counted"), F.col("copies").alias("n_copies"))
    number = safe_name([*docs.columns, row, "counted", "n_copies"], "copy_no")
    joined = rows.alias("d").join(counts.alias("c"), F.col(f"d.`{row}`") == F.col("c.counted")).where(F.col("c.n_copies") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("c.n_copies").cast("int"))).alias(number)
    return joined.select(copies, *[F.col(f"d.`{x}`") for x in docs.columns]).drop(number)
