"""The query and SQL of the decontamination operator."""

from __future__ import annotations

from saltmarsh.llm.decontaminate import judged, scan

OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM bw WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl),
bg AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bl),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, ns WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM di),
m AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dg d JOIN bg b ON d.n = b.n AND d.g = b.g),
hw AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hw GROUP BY doc_id),
t AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM t GROUP BY doc_id)
SELECT dw.doc_id, len(dw.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(dw.ws) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op3_decontamination(spark, sf_dir):
    """Every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(scan(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
