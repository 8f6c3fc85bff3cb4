"""Queries that prepare corpora: conditioning, trimming, packing, sampling, quotas, contamination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.operators import corpus as C
from saltmarsh.plans.core import register, table


@register(
    "last_user_conditioned",
    """
    WITH m AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn = last THEN '[calm]' || text ELSE text END AS text FROM m
    """,
)
def last_user_conditioned(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return C.condition_last_user(turns, "conv_id", "turn", F.lit("[calm]")).select("conv_id", "turn", "role", "text")


@register(
    "context_trim",
    """
    WITH c AS (SELECT conv_id, turn, (floor(length(text) / 1.5) + 1)::BIGINT AS cost FROM conversations),
    s AS (SELECT *, sum(cost) OVER w AS upto, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, turn, cost, upto <= 400 OR rn = 1 AS kept FROM s
    """,
)
def context_trim(spark, sf_dir):
    return C.trimmed_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", 400).select("conv_id", "turn", "cost", "kept")


@register(
    "packed_blocks",
    """
    WITH p AS (SELECT doc_id, n_chars + 1 AS n, coalesce(sum(n_chars + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents),
    e AS (SELECT doc_id, unnest(range((s // 1025)::BIGINT, ((s + n - 1) // 1025 + 1)::BIGINT)) AS block FROM p)
    SELECT block::BIGINT AS block, min(doc_id) AS first, max(doc_id) AS last, count(*) AS texts FROM e GROUP BY block
    HAVING (block + 1) * 1025 <= (SELECT sum(n_chars + 1) FROM documents)
    """,
)
def packed_blocks(spark, sf_dir):
    return C.packed_blocks(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 1024).select("block", "first", "last", "texts")


@register(
    "row_group_offsets",
    """
    WITH g AS (SELECT l_orderkey // 1000 AS grp, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT grp, n, coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g
    """,
)
def row_group_offsets(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 1000).alias("grp")).agg(F.count("*").alias("n"))
    return C.running_offsets(groups, "grp", "n").select("grp", "n", "start")


@register(
    "row_group_lookup",
    """
    WITH g AS (SELECT o_custkey // 100 AS grp, count(*) AS n FROM orders GROUP BY 1),
    o AS (SELECT grp, n, coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g),
    i AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE (SELECT count(*) FROM orders) - 1 - event_id % 1000 END AS pos FROM events)
    SELECT event_id, grp, pos - start AS within FROM i JOIN o ON pos >= start AND pos < start + n
    """,
)
def row_group_lookup(spark, sf_dir):
    from saltmarsh.sources.readers import located

    groups = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 100).alias("row_group")).agg(F.count("*").alias("num_rows"))
    offsets = C.running_offsets(groups, "row_group", "num_rows").select(F.lit("orders").alias("file"), "row_group", "num_rows", F.col("start").alias("offset"))
    k = F.col("event_id") % 1000
    asked = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, k).otherwise(-1 - k).alias("at"))
    # The same few indices are asked for by many rows: each is looked up once.
    places = located(offsets, asked.select("at").distinct(), "at")
    return asked.join(places, "at").select("event_id", F.col("row_group").alias("grp"), "within")


@register(
    "label_left_join",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def label_left_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id").join(labels.select("doc_id", "quality", F.lit(True).alias("there")), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("there").isNull().alias("missing"))


@register(
    "label_distribution",
    """
    WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)
    SELECT quality, toxic, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share,
           round((SELECT count(*) FROM documents) * (n::DOUBLE / sum(n) OVER ()) * 3.5 / 3600, 6) AS hours,
           n::DOUBLE / sum(n) OVER () >= 0.10 AS passes
    FROM c
    """,
)
def label_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    shared = counts.withColumn("share", share).join(F.broadcast(total))
    return shared.select("quality", "toxic", "n", F.round("share", 9).alias("share"), F.round(F.col("rows") * F.col("share") * 3.5 / 3600, 6).alias("hours"), (F.col("share") >= 0.10).alias("passes"))


@register(
    "label_precision",
    """
    SELECT d.lang, count(*) AS total, count(*) FILTER (l.quality = 1) AS agree, round(avg((l.quality = 1)::INT::DOUBLE), 9) AS precision,
           (SELECT count(*) FROM documents x WHERE x.lang = d.lang) - count(*) AS unsure
    FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang
    """,
)
def label_precision(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    heard = F.col("quality").isNotNull()
    joined = docs.join(labels, "doc_id", "left").groupBy("lang")
    agree = F.count_if(heard & (F.col("quality") == 1))
    return joined.agg(F.count_if(heard).alias("total"), agree.alias("agree"), F.round(F.try_divide(agree, F.count_if(heard)), 9).alias("precision"), F.count_if(~heard).alias("unsure")).where("total > 0")


@register("contamination_exact", "SELECT DISTINCT doc_id FROM documents WHERE source = 'src0' AND text IN (SELECT text FROM documents WHERE source <> 'src0')")
def contamination_exact(spark, sf_dir):
    from saltmarsh.operators.governance import verbatim_members

    docs = table(spark, sf_dir, "documents")
    return verbatim_members(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "text").select("doc_id").distinct()


@register("unseen_texts", "SELECT doc_id FROM documents d ANTI JOIN conversations c ON d.text = c.text")
def unseen_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "conversations").select("text").distinct(), "text", "left_anti").select("doc_id")


@register(
    "near_duplicate_items",
    r"""
    WITH s AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS t FROM benchmark),
    g AS (SELECT item_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g, list_distinct(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))) AS c FROM s),
    p AS (SELECT a.item_id AS a, b.item_id AS b,
                 len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS x,
                 len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))) AS y
          FROM g a JOIN g b ON a.item_id < b.item_id)
    SELECT a, b, round(x, 9) AS bigram_jaccard, round(y, 9) AS character_jaccard FROM p WHERE x >= 0.6 OR y >= 0.9
    """,
)
def near_duplicate_items(spark, sf_dir):
    pairs = C.near_duplicate_pairs(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return pairs.select("a", "b", F.round("bigram_jaccard", 9).alias("bigram_jaccard"), F.round("character_jaccard", 9).alias("character_jaccard"))


@register(
    "theme_quota",
    """
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    q AS (SELECT source, n, round_even(n * 333::DOUBLE / sum(n) OVER (), 0)::BIGINT AS quota FROM c),
    r AS (SELECT *, row_number() OVER (ORDER BY quota DESC, source) AS rn, 333 - sum(quota) OVER () AS drift FROM q)
    SELECT source, n, (quota + CASE WHEN rn = 1 THEN drift ELSE 0 END)::BIGINT AS quota FROM r
    """,
)
def theme_quota(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return C.theme_quotas(counts, "source", "n", 333).select("source", "n", "quota")


@register(
    "theme_drift",
    """
    WITH a AS (SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM documents WHERE lang = 'en') AS s FROM documents WHERE lang = 'en' GROUP BY source),
    b AS (SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM documents WHERE lang <> 'en') AS s FROM documents WHERE lang <> 'en' GROUP BY source)
    SELECT coalesce(a.source, b.source) AS source, round(coalesce(b.s, 0) - coalesce(a.s, 0), 9) AS drift,
           round(max(abs(coalesce(b.s, 0) - coalesce(a.s, 0))) OVER (), 9) AS max_drift
    FROM a FULL JOIN b ON a.source = b.source
    """,
)
def theme_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    english = F.col("lang") == "en"
    counts = docs.groupBy("source").agg(F.count_if(english).alias("a"), F.count_if(~english).alias("b"))
    every = Window.partitionBy()
    drift = F.col("b") / F.sum("b").over(every) - F.col("a") / F.sum("a").over(every)
    drifts = counts.withColumn("d", drift)
    return drifts.select("source", F.round("d", 9).alias("drift"), F.round(F.max(F.abs("d")).over(every), 9).alias("max_drift"))


@register(
    "per_group_sample",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 7",
)
def per_group_sample(spark, sf_dir):
    return C.per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7, seed=3)


@register(
    "window_shuffle",
    """
    WITH g AS (SELECT source, (row_number() OVER (ORDER BY md5('5:group:' || source), source) - 1) // 2 AS w FROM (SELECT DISTINCT source FROM documents)),
    j AS (SELECT doc_id, w FROM documents JOIN g USING (source))
    SELECT doc_id, w::BIGINT AS shuffle_window, (row_number() OVER (ORDER BY w, md5('5:row:' || doc_id), doc_id) - 1)::BIGINT AS position FROM j
    """,
)
def window_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.window_shuffle(rows, "source", "doc_id", seed=4, epoch=1).select("doc_id", "shuffle_window", "position")


@register(
    "strata_ceil_chunks",
    """
    WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, floor(rn / ceil(n / 7.0))::BIGINT AS stratum FROM r
    """,
)
def strata_ceil_chunks(spark, sf_dir):
    return C.ceil_strata(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 7).select("c_custkey", "stratum")


@register(
    "rotated_replies",
    """
    WITH r AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS rn, count(*) OVER () AS n FROM supplier)
    SELECT a.s_suppkey, b.s_name AS swapped FROM r a JOIN r b ON (a.rn + 3) % a.n = b.rn
    """,
)
def rotated_replies(spark, sf_dir):
    return C.rotated(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", 3).select("s_suppkey", "swapped")


@register(
    "held_out_split",
    "SELECT c_custkey, row_number() OVER (ORDER BY md5('9:' || c_custkey), c_custkey) <= floor(count(*) OVER () * 0.15) AS held_out FROM customer",
)
def held_out_split(spark, sf_dir):
    return C.held_out_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.15, seed=9)


@register(
    "pair_draw",
    """
    WITH p AS (SELECT a.conv_id, a.turn AS left_draft, b.turn AS right_draft, abs(length(a.text) - length(b.text)) AS gap
               FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE abs(length(a.text) - length(b.text)) <= 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY md5('0:' || conv_id || ':' || left_draft || ':' || right_draft)) AS rn FROM p)
    SELECT conv_id, left_draft, right_draft, gap FROM r WHERE rn <= 3
    """,
)
def pair_draw(spark, sf_dir):
    pairs = C.drawn_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3, max_gap=200)
    return pairs.select("conv_id", "left_draft", "right_draft", "gap")


@register(
    "shortest_and_longest",
    """
    WITH r AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant'),
    s AS (SELECT conv_id, arg_min(turn, n * 100000 + turn) AS shortest, arg_max(turn, n * 100000 - turn) AS longest, min(n) AS lo, max(n) AS hi FROM r GROUP BY conv_id)
    SELECT conv_id, shortest, longest, hi - lo AS gap FROM s WHERE hi - lo >= 20
    """,
)
def shortest_and_longest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("n", F.length("text"))
    out = rows.groupBy("conv_id").agg(F.min_by("turn", F.struct("n", "turn")).alias("shortest"), F.max_by("turn", F.struct(F.col("n"), -F.col("turn"))).alias("longest"), (F.max("n") - F.min("n")).alias("gap"))
    return out.where("gap >= 20")


@register(
    "nth_draft",
    "SELECT conv_id || '#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS key, turn FROM conversations WHERE role = 'assistant'",
)
def nth_draft(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("#"), nth.cast("string")).alias("key"), "turn")


@register(
    "rater_sheets",
    """
    WITH r AS (SELECT DISTINCT 1 + k AS rater FROM range(3) t(k)),
    e AS (SELECT item_id, 0 AS repeated FROM benchmark UNION ALL SELECT item_id, 1 FROM benchmark WHERE item_id % 10 = 0),
    o AS (SELECT rater, item_id, repeated, row_number() OVER (PARTITION BY rater ORDER BY md5((11 + rater) || ':' || item_id || ':' || repeated)) - 1 AS pos FROM r, e)
    SELECT rater::INTEGER AS rater, item_id || '#' || pos AS token, lpad((pos + 1)::VARCHAR, 3, '0') AS file FROM o
    """,
)
def rater_sheets(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    entries = items.withColumn("repeated", F.lit(0)).union(items.where("item_id % 10 = 0").withColumn("repeated", F.lit(1)))
    sheets = entries.withColumn("rater", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    order = C.hash_rank(F.col("rater") + 11, F.col("item_id"), F.col("repeated"))
    pos = F.row_number().over(Window.partitionBy("rater").orderBy(order)) - 1
    placed = sheets.withColumn("pos", pos)
    token = F.concat(F.col("item_id").cast("string"), F.lit("#"), F.col("pos").cast("string"))
    return placed.select("rater", token.alias("token"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0").alias("file"))


@register(
    "arm_rotation",
    "SELECT event_id, (event_id % 50 + k) % 4 AS arm, k AS place FROM events, range(4) r(k)",
)
def arm_rotation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    return rows.select("event_id", ((F.col("event_id") % 50 + F.col("place")) % 4).alias("arm"), F.col("place").cast("long").alias("place"))


@register(
    "probe_rows",
    "SELECT item_id, i.name AS instruction, i.words || text AS prompt FROM benchmark, (VALUES ('calm', 'Calmly: '), ('glad', 'Gladly: '), ('firm', 'Firmly: ')) i(name, words)",
)
def probe_rows(spark, sf_dir):
    words = spark.createDataFrame([("calm", "Calmly: "), ("glad", "Gladly: "), ("firm", "Firmly: ")], "instruction string, words string")
    return table(spark, sf_dir, "benchmark").join(F.broadcast(words)).select("item_id", "instruction", F.concat("words", "text").alias("prompt"))


@register(
    "near_earlier_items",
    r"""
    WITH s AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS t FROM benchmark),
    g AS (SELECT item_id, list_distinct(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))) AS c FROM s),
    p AS (SELECT b.item_id AS b, len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))) AS y FROM g a JOIN g b ON a.item_id < b.item_id)
    SELECT b AS item_id, count(*) AS earlier FROM p WHERE y >= 0.8 GROUP BY b
    """,
)
def near_earlier_items(spark, sf_dir):
    pairs = C.near_duplicate_pairs(table(spark, sf_dir, "benchmark"), "item_id", "text", bigrams=0.8, characters=0.8)
    return pairs.where("character_jaccard >= 0.8").groupBy(F.col("b").alias("item_id")).agg(F.count("*").alias("earlier"))
