"""Queries of the selection operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import stats as S
from saltmarsh.functions import text as T
from saltmarsh.operators import selection as O
from saltmarsh.operators.governance import scan_lines
from saltmarsh.plans.core import register, table


@register("allowed_documents", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowed_documents(spark, sf_dir):
    return O.allowed(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", table(spark, sf_dir, "labels").where("quality = 1"))


@register(
    "fitted_turns",
    r"""
    WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '^([^.]*\.).*$', '\1', 's') AS short FROM conversations)
    SELECT CASE WHEN length(text) <= 80 THEN 'kept' WHEN length(short) <= 80 THEN 'rewritten' ELSE 'dropped' END AS outcome, count(*) AS n,
           sum(length(CASE WHEN length(text) > 80 AND length(short) <= 80 THEN short ELSE text END))::BIGINT AS chars
    FROM t GROUP BY 1
    """,
)
def fitted_turns(spark, sf_dir):
    first = F.regexp_replace("text", r"(?s)^([^.]*\.).*$", "$1")
    fitted = O.fitted(table(spark, sf_dir, "conversations"), "text", 80, first)
    return fitted.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("single_part", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1")
def single_part(spark, sf_dir):
    return O.single_row(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")


@register("worker_shards", "SELECT (o_orderkey // 1000) % 4 AS worker, count(DISTINCT o_orderkey // 1000) AS row_groups, count(*) AS n FROM orders GROUP BY 1")
def worker_shards(spark, sf_dir):
    """What each of four workers gets of all row groups."""
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("row_group"))
    each = [O.in_shard(rows, "row_group", 4, k).withColumn("worker", F.lit(k).cast("long")) for k in range(4)]
    return reduce(DataFrame.unionByName, each).groupBy("worker").agg(F.count_distinct("row_group").alias("row_groups"), F.count("*").alias("n"))


@register(
    "picked_rows",
    """
    WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('pick:' || c_custkey), c_custkey) AS k FROM customer),
    s AS (SELECT *, greatest(1, 60 // (SELECT count(DISTINCT c_nationkey) FROM customer) + 1) AS share FROM r)
    SELECT c_nationkey, c_custkey FROM s WHERE k <= share ORDER BY c_nationkey, k LIMIT 60
    """,
)
def picked_rows(spark, sf_dir):
    return O.picked(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 60)


@register(
    "spread_sample",
    """
    WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('spread:' || doc_id), doc_id) AS k FROM documents)
    SELECT source, doc_id FROM r WHERE k <= ceil(50.0 / (SELECT count(DISTINCT source) FROM documents))
    """,
)
def spread_sample(spark, sf_dir):
    return O.spread(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 50)


@register(
    "two_stage_sample",
    """
    WITH g AS (SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer) ORDER BY md5('stage:' || c_nationkey), c_nationkey LIMIT 5),
    r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('stage:' || c_custkey), c_custkey) AS k FROM customer SEMI JOIN g USING (c_nationkey))
    SELECT c_nationkey, c_custkey FROM r WHERE k <= 3
    """,
)
def two_stage_sample(spark, sf_dir):
    return O.two_stage(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 5, 3)


@register("most_common_types", "SELECT p_type, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, p_type LIMIT 10")
def most_common_types(spark, sf_dir):
    return O.most_common(table(spark, sf_dir, "part"), "p_type", 10)


@register("worst_balances", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal, c_custkey LIMIT 10")
def worst_balances(spark, sf_dir):
    return O.worst(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


@register(
    "resolved_ratings",
    """
    WITH r AS (SELECT event_id, user_id AS position, event_type || CASE WHEN value > 100 THEN '#' || user_id ELSE '' END AS name FROM events),
    k AS (SELECT DISTINCT c_custkey AS position, 'voice' || c_nationkey AS token FROM customer WHERE c_acctbal > 0),
    j AS (SELECT r.*, coalesce(k.token, nullif(regexp_extract(name, '^([^#]+)#', 1), '')) AS token FROM r LEFT JOIN k USING (position))
    SELECT token, count(*) AS n FROM j GROUP BY token
    """,
)
def resolved_ratings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.concat("event_type", F.when(F.col("value") > 100, F.concat(F.lit("#"), F.col("user_id").cast("string"))).otherwise(F.lit("")))
    ratings = events.select("event_id", F.col("user_id").alias("position"), name.alias("name"))
    key = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("position"), F.concat(F.lit("voice"), F.col("c_nationkey").cast("string")).alias("token")).distinct()
    return O.resolved(ratings, key, "name", strict=False).groupBy("token").agg(F.count("*").alias("n"))


@register(
    "repacked_sheets",
    "SELECT o_custkey AS rater, o_orderkey AS token, lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR, 3, '0') AS file FROM orders",
)
def repacked_sheets(spark, sf_dir):
    return O.repacked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rater"), F.col("o_orderkey").alias("token")), "rater", "token")


@register(
    "matched_judgements",
    """
    WITH j AS (SELECT coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END, ''), (event_id % 40)::VARCHAR) AS key, event_type AS winner FROM events),
    p AS (SELECT c_custkey::VARCHAR AS key, c_nationkey FROM customer WHERE c_acctbal > 0)
    SELECT c_nationkey, p.key IS NOT NULL AS matched, count(*) AS n FROM j LEFT JOIN p USING (key) GROUP BY ALL
    """,
)
def matched_judgements(spark, sf_dir):
    key = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    told = table(spark, sf_dir, "events").select(key.alias("key"), (F.col("event_id") % 40).cast("string").alias("id"), F.col("event_type").alias("winner"))
    pairs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), "c_nationkey")
    return O.matched(told, pairs).groupBy("c_nationkey", "matched").agg(F.count("*").alias("n"))


@register(
    "heard_samples",
    "SELECT source, count(*) AS samples, count(l.quality) AS heard, round(avg(l.quality), 9) AS mean FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
)
def heard_samples(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score"))
    out = O.heard(table(spark, sf_dir, "documents").select("doc_id", "source"), scores, "doc_id")
    return out.groupBy("source").agg(F.count("*").alias("samples"), F.count("score").alias("heard"), F.round(F.avg("score"), 9).alias("mean"))


@register(
    "generation_settings",
    "SELECT o_orderpriority AS priority, count(*) AS runs, count(CASE WHEN o_totalprice > 150000 THEN 1 END) AS with_settings, max(CASE WHEN o_totalprice > 150000 THEN o_orderstatus END) AS greatest FROM orders GROUP BY 1",
)
def generation_settings(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").withColumn("generated", (F.col("o_totalprice") > 150000).cast("int"))
    out = O.settings_of(runs, "generated", "o_orderstatus", "o_orderdate")
    out = out.select("o_orderpriority", "generation_settings", F.col("generation_settings")["o_orderstatus"].alias("status"))
    return out.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("runs"), F.count("generation_settings").alias("with_settings"), F.max("status").alias("greatest"))


@register(
    "set_digests",
    "WITH d AS (SELECT lang, sha256(coalesce(text, '')) AS h FROM documents) SELECT lang, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM d GROUP BY lang",
)
def set_digests(spark, sf_dir):
    return O.set_digest(table(spark, sf_dir, "documents"), "text", "lang")


@register(
    "behavioural_evidence",
    """
    WITH c AS (SELECT source, (quality = 1)::INT AS hit FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
    SELECT source, count(*) AS n, round(avg(hit), 9) AS ordered, round(1.96 * sqrt(0.25 / count(*)), 9) AS noise, avg(hit) - 0.5 > 1.96 * sqrt(0.25 / count(*)) AS evident FROM c GROUP BY source
    """,
)
def behavioural_evidence(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null")
    out = O.behavioural_evidence(cases, F.col("quality") == 1, "source")
    return out.select("source", "n", F.round("ordered", 9).alias("ordered"), F.round("noise", 9).alias("noise"), "evident")


@register(
    "message_rule_scan",
    r"""
    WITH m AS (SELECT conv_id, string_agg(text || CASE WHEN turn % 4 = 0 THEN chr(10) || 'host 10.1.2.3' ELSE '' END, chr(0) ORDER BY turn) AS log FROM conversations GROUP BY conv_id),
    l AS (SELECT conv_id, unnest(string_split(log, chr(0))) AS message FROM m), b AS (SELECT conv_id, unnest(string_split(message, chr(10))) AS body FROM l)
    SELECT conv_id::VARCHAR AS log, 'internal_address' AS rule, count(*) AS lines FROM b WHERE regexp_matches(body, '\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') GROUP BY 1
    """,
)
def message_rule_scan(spark, sf_dir):
    """Messages of a NUL-separated log, line by line, under the rules of released files."""
    turn = F.concat("text", F.when(F.col("turn") % 4 == 0, F.lit("\nhost 10.1.2.3")).otherwise(F.lit("")))
    told = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("log"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", turn.alias("message"))))
    logs = told.agg(F.array_join(F.transform(ordered, lambda x: x["message"]), "\0").alias("body"))
    messages = logs.select("log", F.explode(F.split("body", "\\x00")).alias("message"))
    return scan_lines(messages, "log", "message").groupBy(F.col("path").alias("log"), "rule").agg(F.count("*").alias("lines"))


_DRAWS = "(r * 1000003 + k * 7919 + 104729) % 2147483647"


@register(
    "cluster_noise_floor",
    f"""
    WITH v AS (SELECT sum(o_totalprice) AS s, count(*) AS c, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS i FROM orders GROUP BY o_orderpriority, o_orderstatus),
    n AS (SELECT count(*) AS n FROM v),
    d AS (SELECT r, ((x * x + x) % 2147483647) % n AS i FROM (SELECT r, n, {_DRAWS} AS x FROM range(200) t(r), range(1000) u(k), n WHERE k < n)),
    m AS (SELECT r, sum(s) / sum(c) AS m FROM d JOIN v USING (i) GROUP BY r), s AS (SELECT list_sort(list(m)) AS m FROM m)
    SELECT (SELECT n FROM n) AS n, round((SELECT sum(s) / sum(c) FROM v), 4) AS mean, round((s.m[196] - s.m[6]) / 2, 4) AS floor FROM s
    """,
)
def cluster_noise_floor(spark, sf_dir):
    out = S.portable_floor(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority", "o_orderstatus"], clustered=True)
    return out.select("n", F.round("mean", 4).alias("mean"), F.round("floor", 4).alias("floor"))


@register(
    "median_noise_floor",
    f"""
    WITH v AS (SELECT avg(c_acctbal) AS v, row_number() OVER (ORDER BY c_nationkey) - 1 AS i FROM customer GROUP BY c_nationkey),
    n AS (SELECT count(*) AS n FROM v),
    d AS (SELECT r, ((x * x + x) % 2147483647) % n AS i FROM (SELECT r, n, {_DRAWS} AS x FROM range(4000) t(r), range(1000) u(k), n WHERE k < n)),
    m AS (SELECT r, quantile_cont(v, 0.5) AS m FROM d JOIN v USING (i) GROUP BY r), s AS (SELECT list_sort(list(m)) AS m FROM m)
    SELECT (SELECT n FROM n) AS n, round((SELECT quantile_cont(v, 0.5) FROM v), 6) AS median, round(s.m[7], 6) AS low, round(s.m[3995], 6) AS high FROM s
    """,
)
def median_noise_floor(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return S.portable_median(groups, "v", ["c_nationkey"]).select("n", *[F.round(c, 6).alias(c) for c in ("median", "low", "high")])


@register(
    "partly_shifted_vectors",
    """
    WITH a AS (SELECT * FROM embeddings WHERE vec_id = 1), b AS (SELECT * FROM embeddings WHERE vec_id = 2),
    s AS (SELECT e.vec_id, CASE WHEN e.label < 3 THEN list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE + 0.5 * (b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE)) ELSE e.embedding::DOUBLE[] END AS v FROM embeddings e, a, b)
    SELECT vec_id, round(list_sum(v), 6) AS total FROM s
    """,
)
def partly_shifted_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    ends = rows.where(F.col("vec_id").isin(1, 2)).agg(F.max(F.when(F.col("vec_id") == 1, F.col("v"))).alias("start"), F.max(F.when(F.col("vec_id") == 2, F.col("v"))).alias("end"))
    moved = rows.join(F.broadcast(ends)).withColumn("v", T.shifted(F.col("v"), F.col("start"), F.col("end"), 0.5, only=F.col("label") < 3))  # one row is broadcast
    return moved.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("folded_numerals")
def folded_numerals(spark, sf_dir):
    """Numbers spelled in Chinese, as digits; SQL has no such parser, so unit tests hold the values."""
    digit = F.array(*[F.lit(c) for c in "零一二三四五六七八九"])
    year = F.transform(F.split(F.col("n_chars").cast("string"), ""), lambda c: F.element_at(digit, c.cast("int") + 1))
    said = table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", F.col("n_chars").cast("string").alias("written"), F.array_join(year, "").alias("said"))
    return said.withColumn("folded", T.numerals_folded(F.col("said")))
