"""The table of named queries, each beside the SQL that checks it, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Add a query under ``name``, with its SQL where SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register(
    "paired_reply_length",
    """
    WITH ranked AS (
      SELECT source, length(text) AS chars,
             row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
      FROM documents WHERE source IN ('src0', 'src1')),
    d AS (SELECT b.chars - a.chars AS delta
          FROM ranked a JOIN ranked b ON a.rn = b.rn WHERE a.source = 'src0' AND b.source = 'src1')
    SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta,
           round(3 * stddev_samp(delta) / sqrt(count(*)), 6) AS line,
           CASE WHEN count(*) < 2 THEN 'reported only'
                WHEN abs(avg(delta)) <= 3 * stddev_samp(delta) / sqrt(count(*)) THEN 'indistinguishable'
                WHEN avg(delta) > 0 THEN 'longer' ELSE 'shorter' END AS verdict
    FROM d
    """,
)
def paired_reply_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1"))
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    ranked = docs.select("source", F.length("text").alias("chars"), rn.alias("rn"))
    first = ranked.where("source = 'src0'").select("rn", F.col("chars").alias("a"))
    second = ranked.where("source = 'src1'").select("rn", F.col("chars").alias("b"))
    delta = first.join(second, "rn").select((F.col("b") - F.col("a")).alias("delta"))
    line = 3 * F.try_divide(F.stddev_samp("delta"), F.sqrt(F.count("*")))
    out = delta.agg(F.count("*").alias("n"), F.avg("delta").alias("m"), line.alias("l"))
    verdict = (
        F.when(F.col("n") < 2, "reported only")
        .when(F.abs("m") <= F.col("l"), "indistinguishable")
        .when(F.col("m") > 0, "longer")
        .otherwise("shorter")
    )
    return out.select("n", F.round("m", 6).alias("mean_delta"), F.round("l", 6).alias("line"), verdict.alias("verdict"))
