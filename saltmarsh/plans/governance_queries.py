"""Queries that scan for what may not be released."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import governance as G
from saltmarsh.plans.core import register, table

_RULES = """
    WITH f AS (SELECT doc_id, text || chr(10) || 'see /home/user' || doc_id || '/x' || chr(10) || 'host 10.0.0.' || (doc_id % 300) || ' sk-' || repeat('a', (doc_id % 40)::INT) AS text FROM documents),
    l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS body, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS line FROM f)"""


@register(
    "rule_line_scan",
    _RULES
    + r"""
    SELECT doc_id::VARCHAR AS path, line::BIGINT AS line, 'personal_path' AS rule FROM l WHERE regexp_matches(body, '(?i)/home/[A-Za-z0-9_-]+|/Users/[A-Za-z0-9_-]+|[A-Za-z]:[\\/]{1,2}(?:Users|UserData|home)\b')
    UNION ALL SELECT doc_id::VARCHAR, line, 'merge_conflict' FROM l WHERE regexp_matches(body, '(?i)^<{7}(\s|$)|^>{7}(\s|$)')
    UNION ALL SELECT doc_id::VARCHAR, line, 'internal_address' FROM l WHERE regexp_matches(body, '(?i)\b(?:192\.168\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b')
    UNION ALL SELECT doc_id::VARCHAR, line, 'credential' FROM l WHERE regexp_matches(body, '(?i)BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|DPAPI')
    """,
)
def rule_line_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seeded = F.concat("text", F.lit("\nsee /home/user"), F.col("doc_id").cast("string"), F.lit("/x\nhost 10.0.0."), (F.col("doc_id") % 300).cast("string"), F.lit(" sk-"), F.repeat(F.lit("a"), (F.col("doc_id") % 40).cast("int")))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), seeded.alias("text"))
    return G.scan_lines(files, "path", "text").select("path", F.col("line").cast("long").alias("line"), "rule")


@register("path_rule_scan", r"SELECT page_id, 'large_asset' AS rule FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '.PARQUET' ELSE '' END AS u FROM pages) WHERE regexp_matches(u, '(?i)\.(pth|pt|ckpt|safetensors|bin|parquet|wav|mp3|flac|env|key|pem)$')")
def path_rule_scan(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PARQUET").otherwise("")).alias("u"))
    found = G.scan_paths(named.select(F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("u")).alias("path")), "path")
    return found.select(F.split_part("path", F.lit("|"), F.lit(1)).cast("long").alias("page_id"), "rule")


@register(
    "unsupported_claims",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id::VARCHAR AS path, line::BIGINT AS line FROM l WHERE contains(body, 'the') AND NOT contains(body, 'of') AND NOT contains(body, 'and')",
)
def unsupported_claims(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return G.claims_without_negation(files, "path", "text", "the", ("of", "and")).select("path", F.col("line").cast("long").alias("line"))


@register("health_rollup", "SELECT CASE WHEN count(*) = 0 THEN 'unavailable' WHEN bool_and(s_acctbal > 0) THEN 'ready' WHEN bool_or(s_acctbal > 0) THEN 'degraded' ELSE 'unavailable' END AS state, count(*) AS parts, count(*) FILTER (s_acctbal > 0) AS ready FROM supplier")
def health_rollup(spark, sf_dir):
    return G.health(table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("up")), "up")


@register("membership_share", "SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)) AS members, count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)) > count(*) // 20 AS refused FROM benchmark b")
def membership_share(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    known = table(spark, sf_dir, "documents").select("text").distinct().withColumn("seen", F.lit(True))
    marked = items.join(known, "text", "left").agg(F.count("*").alias("n"), F.count_if(F.col("seen")).alias("members"))
    return marked.select("n", "members", G.membership_refused(F.col("members"), F.col("n")).alias("refused"))


@register(
    "licence_summary",
    "SELECT p_brand AS asset, count(*) AS total, count(*) FILTER (p_retailprice > 1000) AS verified, count(*) FILTER (p_retailprice <= 1000) AS unverified FROM part GROUP BY p_brand",
)
def licence_summary(spark, sf_dir):
    fine = F.col("p_retailprice") > 1000
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.count("*").alias("total"), F.count_if(fine).alias("verified"), F.count_if(~fine).alias("unverified"))


@register(
    "endpoint_difference",
    "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9800), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'undocumented' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'unimplemented' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)",
)
def endpoint_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("undocumented")).union(b.exceptAll(a).withColumn("side", F.lit("unimplemented")))
