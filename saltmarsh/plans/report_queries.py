"""Queries over reports, provenance and named tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import reports as R
from saltmarsh.plans.core import register, table


def _measured(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("report"), F.col("event_type").alias("name"))
    floor = F.lit(1.96) * F.stddev_samp("value") / F.sqrt(F.count("*"))
    found = rows.agg(F.avg("value").alias("value"), floor.alias("noise_floor"), F.count("*").alias("sample_size"))
    return found.withColumn("gating_eligible", (F.col("sample_size") >= 100) & (3 * F.col("noise_floor") <= 8))


_MEASURED = "WITH m AS (SELECT user_id % 10 AS report, event_type AS name, avg(value) AS value, 1.96 * stddev_samp(value) / sqrt(count(*)) AS f, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT *, n >= 100 AND 3 * f <= 8 AS ok FROM m)"


@register("measurement_listing", f"{_MEASURED} SELECT report, name, round(value, 6) AS value, n AS sample_size, CASE WHEN ok THEN 'gates' ELSE 'reported only' END AS mark FROM e")
def measurement_listing(spark, sf_dir):
    entry = F.struct("value", "noise_floor", "sample_size", "gating_eligible", F.lit("").alias("note"))
    reports = _measured(spark, sf_dir).groupBy("report").agg(F.map_from_entries(F.collect_list(F.struct(F.col("name"), entry))).alias("measurements"))
    return R.measurement_listing(reports).select("report", "name", F.round("value", 6).alias("value"), "sample_size", "mark")


@register("not_claimed", f"{_MEASURED} SELECT report, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS not_claimed, count(*) AS measured FROM e GROUP BY report")
def not_claimed(spark, sf_dir):
    return R.not_claimed(_measured(spark, sf_dir), "report").select("report", F.array_join("not_claimed", ",").alias("not_claimed"), "measured")


@register("classified_sources", "SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'other' END AS theme, count(*) AS n FROM documents GROUP BY 1")
def classified_sources(spark, sf_dir):
    theme = R.classified(F.col("source"), ["src0", "src1", "src2"])
    return table(spark, sf_dir, "documents").groupBy(theme.alias("theme")).agg(F.count("*").alias("n"))


@register("claimed_parts", """SELECT CASE WHEN starts_with(p_name, 'a') THEN 'first' WHEN starts_with(p_name, 'Part') OR starts_with(p_name, 'part') THEN 'part' ELSE 'unclaimed' END AS "group", count(*) AS n FROM part GROUP BY 1""")
def claimed_parts(spark, sf_dir):
    return R.claimed_by_prefix(table(spark, sf_dir, "part"), "p_name", {"a": "first", "Part": "part", "part": "part"}).groupBy("group").agg(F.count("*").alias("n"))


@register("merged_weights", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merged_weights(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return R.merged_weights(base, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k")


@register("usable_voices", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND label >= 0")
def usable_voices(spark, sf_dir):
    return R.usable_voices(table(spark, sf_dir, "embeddings").where("label >= 0"), "embedding", "embedding", 64, 64).select("vec_id")


_CLONES = "WITH a AS (SELECT label || '/' || vec_id AS id, embedding[1]::DOUBLE AS s1, embedding[2]::DOUBLE AS s0, embedding[1] > 0 AS h1, embedding[2] > 0 AS h0 FROM embeddings)"


def _clones(spark, sf_dir, place):
    x = F.element_at("embedding", place)
    return table(spark, sf_dir, "embeddings").select(F.concat_ws("/", "label", "vec_id").alias("id"), x.cast("double").alias("similarity"), (x > 0).alias("hit"))


@register(
    "clone_report",
    f"""{_CLONES}, v AS (SELECT split_part(id, '/', 1) AS voice, count(*) AS clips, avg(s1 - s0) AS similarity, sum(h1::INT - h0::INT)::BIGINT AS hits, avg(h1::INT - h0::INT) AS rate FROM a GROUP BY 1),
    w AS (SELECT sum(similarity * clips) / sum(clips) AS s, 3 * 1.96 * stddev_samp(similarity) / sqrt(count(*)) AS st, sum(hits) / sum(clips) AS h, 3 * 1.96 * stddev_samp(rate) / sqrt(count(*)) AS ht FROM v)
    SELECT voice, clips, round(similarity, 6) AS similarity, hits,
           CASE WHEN abs(s) <= st THEN 'indistinguishable' WHEN s > 0 THEN 'improved' ELSE 'regressed' END || CASE WHEN (abs(s) <= st AND st > 0.05) OR (abs(s) > st AND abs(s) < 0.05) THEN ', report only' ELSE '' END AS similarity_verdict,
           CASE WHEN abs(h) <= ht THEN 'indistinguishable' WHEN h > 0 THEN 'improved' ELSE 'regressed' END || CASE WHEN (abs(h) <= ht AND ht > 0.10) OR (abs(h) > ht AND abs(h) < 0.10) THEN ', report only' ELSE '' END AS hit_verdict
    FROM v, w""",
)
def clone_report(spark, sf_dir):
    out = R.clone_report(_clones(spark, sf_dir, 1), _clones(spark, sf_dir, 2))
    return out.withColumn("similarity", F.round("similarity", 6))


@register(
    "valid_pairs",
    """
    WITH a AS (SELECT doc_id::VARCHAR AS id, text, n_chars AS x FROM documents), b AS (SELECT doc_id::VARCHAR AS id, text, doc_id AS x FROM documents JOIN labels USING (doc_id)),
    p AS (SELECT a.id, a.x, b.x AS x_reference, a.text IS NOT DISTINCT FROM b.text AS same FROM a JOIN b USING (id))
    SELECT id, x, x_reference FROM p WHERE (SELECT bool_and(same) AND count(*) >= greatest(2, floor(0.8 * least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))) FROM p)
    """,
)
def valid_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("n_chars").alias("x"))
    other = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("x"))
    return R.valid_pairs(own, other, "id", "text", ["x"])
