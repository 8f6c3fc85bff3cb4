"""The query and SQL of the mixing operator."""

from __future__ import annotations

from saltmarsh.llm.mixing import pareto_mix

OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, '~' || sha256(text), '') AS name
  FROM documents),
leaned AS (SELECT *, floor(10000.0::DOUBLE / sqrt(1.0::DOUBLE + size))::BIGINT AS lean FROM base),
totals AS (SELECT skey, sum(size)::BIGINT AS source_size, sum(lean * size)::BIGINT AS leaning FROM leaned GROUP BY skey),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM totals),
roomed AS (SELECT *, (3 * source_size)::DOUBLE / w AS room FROM weighted),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM roomed),
targets AS (
  SELECT skey, source_size, leaning,
         CASE WHEN room <= level THEN (3 * source_size)::DOUBLE
              ELSE w * (SELECT arg_min(level, room) FROM levels WHERE room > level) END AS target
  FROM levels),
sources AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS missing
  FROM targets),
drawn AS (
  SELECT b.*, s.source_size, s.target, s.whole, s.missing, s.leaning,
         (('0x' || substr(sha256('mix-1:' || b.name), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         CASE WHEN s.leaning > 0 THEN least(greatest(s.missing * b.lean / s.leaning, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) ELSE 0.5 END AS p
  FROM leaned b JOIN sources s USING (skey)),
ranked AS (
  SELECT *, CASE WHEN leaning > 0 THEN (u / (1 - u)) * ((1 - p) / p) ELSE 1.0 END AS odds FROM drawn),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN missing > 0 AND before + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op8_mixing(spark, sf_dir):
    """All of ``documents`` mixed with the production weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
