"""Queries over vectors and named tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import vectors as V
from saltmarsh.plans.core import register, table

_COSINE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _voices(rows):
    """The first vector of each label stands for its voice."""
    return rows.groupBy(F.col("label").alias("voice")).agg(F.min_by("embedding", "vec_id").alias("v"))


@register(
    "identify_top1",
    f"""
    WITH v AS (SELECT label AS voice, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
    s AS (SELECT e.vec_id, e.label, v.voice, {_COSINE.format(a='e.embedding', b='v.v')} AS s FROM embeddings e, v)
    SELECT vec_id, label, arg_max(voice, s) AS nearest, round(max(s) FILTER (voice = label), 6) AS own_similarity, round(max(s) FILTER (voice = label) - max(s) FILTER (voice <> label), 6) AS margin, arg_max(voice, s) = label AS hit
    FROM s GROUP BY vec_id, label
    """,
)
def identify_top1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = V.identify(rows, _voices(rows), "vec_id", "label", "embedding")
    return found.select("vec_id", "label", "nearest", F.round("own_similarity", 6).alias("own_similarity"), F.round("margin", 6).alias("margin"), "hit")


@register(
    "cosine_edges",
    f"WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT a, b, round(s, 6) AS similarity FROM s WHERE s > 0.35",
)
def cosine_edges(spark, sf_dir):
    return V.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@register("speaker_clusters")
def speaker_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return V.greedy_clusters(rows, "vec_id", "embedding", 0.35, 3)


@register(
    "shifted_vectors",
    """
    WITH a AS (SELECT arg_min(embedding, vec_id) AS s, arg_max(embedding, vec_id) AS e FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE + 0.5 * (e[i]::DOUBLE - s[i]::DOUBLE))), 6) AS total FROM embeddings, a
    """,
)
def shifted_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ends = rows.agg(F.min_by("v", "vec_id").alias("s"), F.max_by("v", "vec_id").alias("e"))
    moved = rows.join(F.broadcast(ends)).select("vec_id", T.shifted(F.col("v"), F.col("s"), F.col("e"), 0.5).alias("m"))
    return moved.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@register(
    "compared_tensors",
    """
    WITH a AS (SELECT l_partkey AS k, l_partkey % 7 AS g, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
    b AS (SELECT l_partkey AS k, l_partkey % 7 AS g, sum(l_quantity) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
    SELECT coalesce(a.g, b.g) AS g, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right,
           count(*) FILTER (x = y) AS identical, round(max(abs(x - y)), 6) AS max_difference FROM a FULL JOIN b ON a.k = b.k GROUP BY 1
    """,
)
def compared_tensors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")

    def side(other):  # every row is on one side or, with the third flag, on both
        return rows.where(F.col("l_returnflag") != other).groupBy(F.col("l_partkey").alias("k"), (F.col("l_partkey") % 7).alias("g")).agg(F.sum("l_quantity").alias("v"))

    out = V.compared_tensors(side("A"), side("R"), "k", "g", "v")
    return out.withColumn("max_difference", F.round("max_difference", 6))


@register(
    "codebook_churn",
    """
    WITH p AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings), q AS (SELECT vec_id + 1 AS vec_id, pos, x AS y FROM p)
    SELECT (pos % 8)::BIGINT AS codebook, count(*) AS n, round(avg((sign(x) <> sign(y))::INT::DOUBLE), 9) AS churn FROM p JOIN q USING (vec_id, pos) GROUP BY 1
    """,
)
def codebook_churn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.signum(x)).alias("codes"))
    after = rows.select((F.col("vec_id") + 1).alias("vec_id"), "codes")
    out = V.codebook_churn(rows, after, "vec_id", "codes")
    return out.select(F.col("codebook").cast("long").alias("codebook"), "n", F.round("churn", 9).alias("churn"))


@register(
    "scores_over_ceiling",
    """
    WITH c AS (SELECT s_nationkey AS k, max(s_acctbal) AS ceiling FROM supplier GROUP BY 1), s AS (SELECT c_nationkey AS k, avg(c_acctbal) AS score FROM customer GROUP BY 1)
    SELECT s.k AS voice, round(score, 6) AS score, round(CASE WHEN ceiling <> 0 THEN score / ceiling END, 9) AS ratio FROM s LEFT JOIN c USING (k)
    """,
)
def scores_over_ceiling(spark, sf_dir):
    ceiling = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("voice")).agg(F.max("s_acctbal").alias("ceiling"))
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("voice")).agg(F.avg("c_acctbal").alias("score"))
    return scores.join(ceiling, "voice", "left").select("voice", F.round("score", 6).alias("score"), F.round(F.try_divide(F.col("score"), F.col("ceiling")), 9).alias("ratio"))


@register(
    "fixture_comparison",
    """
    WITH p AS (SELECT l_orderkey % 50 AS pos, abs(l_quantity - l_linenumber * 7) AS d FROM lineitem), m AS (SELECT pos, max(d) AS d FROM p GROUP BY pos)
    SELECT count(*) AS positions, round(max(d), 6) AS worst, round(quantile_cont(d, 0.99) / quantile_cont(d, 0.5), 6) AS spread FROM m
    """,
)
def fixture_comparison(spark, sf_dir):
    d = F.abs(F.col("l_quantity") - F.col("l_linenumber") * 7)
    worst = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("pos")).agg(F.max(d).alias("d"))
    return worst.agg(F.count("*").alias("positions"), F.round(F.max("d"), 6).alias("worst"), F.round(F.percentile("d", F.lit(0.99)) / F.percentile("d", F.lit(0.5)), 6).alias("spread"))
