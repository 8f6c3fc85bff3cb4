"""Queries that measure: quantiles, paired and clustered comparisons, noise, training logs, latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.functions import quantiles as Q
from saltmarsh.functions import stats as S
from saltmarsh.plans.core import register, table
from saltmarsh.session import cut

_SORTED = "SELECT event_type, list_sort(list(value)) AS x, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type"


def _at_ranks(spark, sf_dir, ranks):
    return Q.at_ranks(table(spark, sf_dir, "events"), "event_type", "value", ranks)


def _between(n, f):
    """The ranks on both sides of the interpolated quantile."""
    return {"low": F.floor(f * (n - 1)), "high": F.ceil(f * (n - 1))}


def _interpolated(n, f):
    place = f * (n - 1)
    return F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))


@register(
    "latency_quantiles",
    f"""
    WITH s AS ({_SORTED})
    SELECT event_type, n, round(x[1 + least(floor(0.95 * n), n - 1)::INT], 9) AS index_capped, round(x[1 + greatest(floor(0.95 * n) - 1, 0)::INT], 9) AS minus_one,
           round(x[1 + least(n * 95 // 100, n - 1)::INT], 9) AS percent_capped, round(x[1 + floor(0.9 * n)::INT], 9) AS uncapped,
           round((SELECT quantile_cont(value, 0.95) FROM events e WHERE e.event_type = s.event_type), 6) AS linear
    FROM s
    """,
)
def latency_quantiles(spark, sf_dir):
    n = F.col("n")
    ranks = {"index_capped": Q.capped_rank(n, 0.95), "minus_one": Q.minus_one_rank(n, 0.95), "percent_capped": Q.percent_rank(n, 95), "uncapped": Q.uncapped_rank(n, 0.9)}
    found = _at_ranks(spark, sf_dir, {**ranks, **_between(n, F.lit(0.95))})
    return found.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ranks], F.round(_interpolated(n, F.lit(0.95)), 6).alias("linear"))


@register("two_medians", f"WITH s AS ({_SORTED}) SELECT event_type, round(x[1 + (n // 2)::INT], 9) AS upper_median, round((SELECT median(value) FROM events e WHERE e.event_type = s.event_type), 6) AS median FROM s")
def two_medians(spark, sf_dir):
    n = F.col("n")
    found = _at_ranks(spark, sf_dir, {"upper": Q.upper_rank(n), **_between(n, F.lit(0.5))})
    return found.select("event_type", F.round("upper", 9).alias("upper_median"), F.round(_interpolated(n, F.lit(0.5)), 6).alias("median"))


@register(
    "value_summary",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 9) AS low, round(max(value), 9) AS high, count(*) FILTER (value > 50) AS over_50 FROM events GROUP BY event_type",
)
def value_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.min("value"), 9).alias("low"), F.round(F.max("value"), 9).alias("high"), F.count_if(F.col("value") > 50).alias("over_50")
    )


@register(
    "token_weighted_nll",
    "SELECT lang, round(sum((n_chars % 97 / 10.0::DOUBLE) * n_chars) / sum(n_chars), 6) AS weighted, round(avg(n_chars % 97 / 10.0::DOUBLE), 6) AS plain FROM documents GROUP BY lang",
)
def token_weighted_nll(spark, sf_dir):
    nll = (F.col("n_chars") % 97) / F.lit(10.0)
    rows = table(spark, sf_dir, "documents").select("lang", "n_chars", nll.alias("nll"))
    return rows.groupBy("lang").agg(F.round(F.sum(F.col("nll") * F.col("n_chars")) / F.sum("n_chars"), 6).alias("weighted"), F.round(F.avg("nll"), 6).alias("plain"))


@register(
    "speech_score_shape",
    """
    WITH c AS (SELECT doc_id, text, (n_chars % 89) / 100.0::DOUBLE AS cer, regexp_matches(text, '[0-9]') AS digits, n_chars < 30 AS silent FROM documents)
    SELECT count(*) AS n, round(avg(cer), 6) AS cer, round(median(cer), 6) AS median_cer, count(*) FILTER (cer > 0.3) AS bad,
           round(avg(silent::INT::DOUBLE), 9) AS silent_rate, round(avg(cer) FILTER (digits), 6) AS with_digits, round(avg(cer) FILTER (NOT digits), 6) AS without_digits,
           CASE WHEN count(*) FILTER (cer > 0.3) > 0.25 * count(*) THEN 'systematic' ELSE 'few hard cases' END AS shape
    FROM c
    """,
)
def speech_score_shape(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    c = docs.select(((F.col("n_chars") % 89) / F.lit(100.0)).alias("cer"), F.col("text").rlike("[0-9]").alias("digits"), (F.col("n_chars") < 30).alias("silent"))
    bad = F.count_if(F.col("cer") > 0.3)
    return c.agg(
        F.count("*").alias("n"),
        F.round(F.avg("cer"), 6).alias("cer"),
        F.round(F.median("cer"), 6).alias("median_cer"),
        bad.alias("bad"),
        F.round(F.avg(F.col("silent").cast("double")), 9).alias("silent_rate"),
        F.round(F.avg(F.when(F.col("digits"), F.col("cer"))), 6).alias("with_digits"),
        F.round(F.avg(F.when(~F.col("digits"), F.col("cer"))), 6).alias("without_digits"),
        F.when(bad > 0.25 * F.count("*"), "systematic").otherwise("few hard cases").alias("shape"),
    )


@register(
    "language_gate",
    """
    SELECT coalesce(lang, 'unknown') AS language, count(*) AS n, round(avg(n_chars % 100 / 100.0::DOUBLE), 6) AS mean,
           avg(n_chars % 100 / 100.0::DOUBLE) + 3 * 1.96 * stddev_samp(n_chars % 100 / 100.0::DOUBLE) / sqrt(count(*)) < 0.6 AS passes
    FROM documents GROUP BY 1
    """,
)
def language_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("unknown")).alias("language"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("v"))
    floor = F.lit(1.96) * F.stddev_samp("v") / F.sqrt(F.count("v"))
    return rows.groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), (F.avg("v") + 3 * floor < 0.6).alias("passes"))


_ARMS = "WITH a AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS x, avg(value) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY user_id), d AS (SELECT user_id, y - x AS delta FROM a WHERE x IS NOT NULL AND y IS NOT NULL)"


def _deltas(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    arms = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(even, F.col("value"))).alias("x"), F.avg(F.when(~even, F.col("value"))).alias("y"))
    return arms.where("x IS NOT NULL AND y IS NOT NULL").select("user_id", "x", "y", (F.col("y") - F.col("x")).alias("delta"))


@register(
    "paired_delta",
    f"""{_ARMS}, s AS (SELECT count(*) AS n, avg(delta) AS m, 3 * 1.96 * stddev_samp(delta) / sqrt(count(*)) AS t FROM d)
    SELECT n, round(m, 6) AS difference, round(t, 6) AS threshold, CASE WHEN abs(m) <= t THEN 'indistinguishable' WHEN m < 0 THEN 'improved' ELSE 'regressed' END
      || CASE WHEN (abs(m) <= t AND t > 0.5) OR (abs(m) > t AND abs(m) < 0.5) THEN ', report only' ELSE '' END AS verdict FROM s""",
)
def paired_delta(spark, sf_dir):
    threshold = S.RESOLVE * F.lit(1.96) * F.stddev_samp("delta") / F.sqrt(F.count("*"))
    out = _deltas(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("delta").alias("m"), threshold.alias("t"))
    return out.select("n", F.round("m", 6).alias("difference"), F.round("t", 6).alias("threshold"), S.verdict(F.col("m"), F.col("t"), True, 0.5).alias("verdict"))


@register(
    "clustered_delta",
    f"""{_ARMS}, c AS (SELECT user_id % 25 AS cluster, delta FROM d), g AS (SELECT cluster, avg(delta) AS m, count(*) AS k FROM c GROUP BY cluster),
    s AS (SELECT (SELECT avg(delta) FROM c) AS m, 3 * 1.96 * stddev_samp(m) / sqrt(count(*)) AS t, count(*) AS clusters, sum(k)::BIGINT AS n FROM g)
    SELECT n, clusters, round(m, 6) AS difference, round(t, 6) AS threshold, CASE WHEN abs(m) <= t THEN 'indistinguishable' WHEN m < 0 THEN 'improved' ELSE 'regressed' END AS verdict FROM s""",
)
def clustered_delta(spark, sf_dir):
    groups = _deltas(spark, sf_dir).groupBy((F.col("user_id") % 25).alias("cluster")).agg(F.avg("delta").alias("g"), F.sum("delta").alias("total"), F.count("*").alias("k"))
    threshold = S.RESOLVE * F.lit(1.96) * F.stddev_samp("g") / F.sqrt(F.count("*"))
    out = groups.agg(F.sum("k").alias("n"), F.count("*").alias("clusters"), (F.sum("total") / F.sum("k")).alias("m"), threshold.alias("t"))
    return out.select("n", "clusters", F.round("m", 6).alias("difference"), F.round("t", 6).alias("threshold"), S.verdict(F.col("m"), F.col("t")).alias("verdict"))


@register(
    "unpaired_compare",
    """
    WITH s AS (SELECT n_regionkey AS region, count(*) AS n, avg(c_acctbal) AS v, 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT b.region, round(b.v - a.v, 6) AS difference, round(3 * sqrt(a.f * a.f + b.f * b.f), 6) AS threshold,
           CASE WHEN b.n < 100 THEN 'reported only' WHEN abs(b.v - a.v) <= 3 * sqrt(a.f * a.f + b.f * b.f) THEN 'indistinguishable' WHEN b.v < a.v THEN 'improved' ELSE 'regressed' END AS verdict
    FROM s a JOIN s b ON a.region = 0 AND b.region > 0
    """,
)
def unpaired_compare(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("region").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("v"), (F.lit(1.96) * F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("f"))
    base = rows.where("region = 0").select(F.col("v").alias("v0"), F.col("f").alias("f0"))
    both = rows.where("region > 0").join(F.broadcast(base)).withColumn("d", F.col("v") - F.col("v0")).withColumn("t", S.RESOLVE * F.sqrt(F.col("f") * F.col("f") + F.col("f0") * F.col("f0")))
    word = F.when(F.col("n") < 100, "reported only").otherwise(S.verdict(F.col("d"), F.col("t")))
    return both.select("region", F.round("d", 6).alias("difference"), F.round("t", 6).alias("threshold"), word.alias("verdict"))


@register(
    "cross_reference_agreement",
    f"""{_ARMS}, p AS (SELECT avg(((a.x > 50) = (a.y > 50))::INT::DOUBLE) AS s, count(*) AS n FROM a WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT n, round(s, 9) AS agreement, round(1.96 * sqrt(0.25 / n), 9) AS noise, s - 0.5 > 1.96 * sqrt(0.25 / n) AS gating_eligible FROM p""",
)
def cross_reference_agreement(spark, sf_dir):
    rows = _deltas(spark, sf_dir).select((F.col("x") - 50).alias("a"), (F.col("y") - 50).alias("b"))
    return S.agreement(rows, "a", "b").select("n", F.round("agreement", 9).alias("agreement"), F.round("noise", 9).alias("noise"), "gating_eligible")


@register(
    "spearman_avg_rank",
    """
    WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY round(p_retailprice)) + (count(*) OVER (PARTITION BY round(p_retailprice)) - 1) / 2.0::DOUBLE AS b FROM part)
    SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r
    """,
)
def spearman_avg_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", F.round("p_retailprice").alias("price"))
    return S.spearman(rows, "p_size", "price").select("n", F.round("rho", 6).alias("rho"))


@register(
    "portable_noise_floor",
    """
    WITH v AS (SELECT avg(c_acctbal) AS v, row_number() OVER (ORDER BY c_nationkey) - 1 AS i FROM customer GROUP BY c_nationkey),
    n AS (SELECT count(*) AS n FROM v),
    d AS (SELECT r, ((x * x + x) % 2147483647) % n AS i FROM (SELECT r, n, (r * 1000003 + k * 7919 + 104729) % 2147483647 AS x FROM range(200) t(r), range(1000) u(k), n WHERE k < n)),
    m AS (SELECT r, avg(v) AS m FROM d JOIN v USING (i) GROUP BY r), s AS (SELECT list_sort(list(m)) AS m FROM m)
    SELECT (SELECT n FROM n) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round((s.m[196] - s.m[6]) / 2, 6) AS floor FROM s
    """,
)
def portable_noise_floor(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return S.portable_floor(groups, "v", ["c_nationkey"]).select("n", F.round("mean", 6).alias("mean"), F.round("floor", 6).alias("floor"))


@register(
    "assessed_measurements",
    """
    WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS v, 1.96 * stddev_samp(value) / sqrt(count(*)) AS f FROM events GROUP BY event_type)
    SELECT event_type, n, round(f, 6) AS floor, n >= 100 AND 3 * f <= 4.0 AS eligible,
           concat_ws('; ', CASE WHEN n < 100 THEN 'too few samples' END, CASE WHEN 3 * f > 4.0 THEN 'cannot resolve the effect' END) AS note FROM s
    """,
)
def assessed_measurements(spark, sf_dir):
    floor = F.lit(1.96) * F.stddev_samp("value") / F.sqrt(F.count("*"))
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), floor.alias("f"))
    eligible, note = S.assessed(F.col("n"), F.col("f"), 4.0)
    return rows.select("event_type", "n", F.round("f", 6).alias("floor"), eligible.alias("eligible"), note.alias("note"))


@register("required_clips", "SELECT raters, ceil(pow((3 * 1.96 * sqrt(0.397 * 0.397 + 2 * 0.25 / raters)) / 0.5, 2))::BIGINT AS clips FROM (SELECT DISTINCT r_regionkey + 1 AS raters FROM region)")
def required_clips(spark, sf_dir):
    raters = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("raters")).distinct()
    return raters.select("raters", S.required_clips(F.lit(0.5), F.col("raters"), F.lit(0.5)).alias("clips"))


@register(
    "dpo_margin",
    """
    WITH m AS (SELECT l_returnflag AS g, (l_quantity - l_tax * 100) - (l_discount * 100 - l_linenumber) AS m FROM lineitem)
    SELECT g AS l_returnflag, count(*) AS n, round(avg(m), 6) AS mean_margin, round(avg((m > 0)::INT::DOUBLE), 9) AS ordered,
           round(avg(CASE WHEN m > 0 THEN ln(1 + exp(-0.1 * m)) ELSE -0.1 * m + ln(1 + exp(0.1 * m)) END), 6) AS loss,
           avg((m > 0)::INT::DOUBLE) - 0.5 > 1.96 * sqrt(0.25 / count(*)) AS learned
    FROM m GROUP BY g
    """,
)
def dpo_margin(spark, sf_dir):
    margin = S.preference_margin(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", margin.alias("m"))
    share = F.avg((F.col("m") > 0).cast("double"))
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean_margin"), F.round(share, 9).alias("ordered"), F.round(F.avg(S.preference_loss(F.col("m"))), 6).alias("loss"), (share - 0.5 > S.binomial_noise(F.count("*"))).alias("learned")
    )


@register(
    "text_regression_gate",
    """
    WITH s AS (SELECT lang, count(*) AS n, avg(n_chars % 347 / 100.0::DOUBLE) AS v, 1.96 * stddev_samp(n_chars % 347 / 100.0::DOUBLE) / sqrt(count(*)) AS f FROM documents GROUP BY lang)
    SELECT lang, round(v, 6) AS value, CASE WHEN n < 30 THEN 'reported only' WHEN abs(v - 1.7268) <= 3 * sqrt(f * f + 0.0020 * 0.0020) THEN 'unchanged' WHEN v > 1.7268 THEN 'regressed' ELSE 'improved' END AS verdict FROM s
    """,
)
def text_regression_gate(spark, sf_dir):
    v = (F.col("n_chars") % 347) / F.lit(100.0)
    rows = table(spark, sf_dir, "documents").select("lang", v.alias("v")).groupBy("lang").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.lit(1.96) * F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("f"))
    return rows.select("lang", F.round("m", 6).alias("value"), S.regression_against(F.col("m"), F.col("f"), F.col("n")).alias("verdict"))


@register(
    "storage_resolution",
    "SELECT o_orderkey, pow(2, floor(log2(o_totalprice)) - 10)::DOUBLE AS step, o_totalprice * 0.001 < 4 * pow(2, floor(log2(o_totalprice)) - 10) AS refused FROM orders WHERE o_totalprice > 0",
)
def storage_resolution(spark, sf_dir):
    step = S.half_precision_step(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", step.alias("step"), (F.col("o_totalprice") * 0.001 < 4 * step).alias("refused"))


@register(
    "epoch_lag_compare",
    """
    WITH p AS (SELECT event_type AS run, user_id % 6 AS epoch, value FROM events),
    e AS (SELECT run, epoch, count(*) AS n, avg(value) AS m, 1.96 * stddev_samp(value) / sqrt(count(*)) AS f FROM p GROUP BY ALL),
    c AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY run) AS fullest FROM e) WHERE n >= greatest(10, floor(fullest * 0.8))),
    l AS (SELECT *, lag(m) OVER w AS pm, lag(f) OVER w AS pf FROM c WINDOW w AS (PARTITION BY run ORDER BY epoch))
    SELECT run, epoch, n, round(m, 6) AS mean, round(m - pm, 6) AS difference, round(3 * sqrt(f * f + pf * pf), 6) AS threshold,
           CASE WHEN pm IS NULL THEN NULL WHEN abs(m - pm) <= 3 * sqrt(f * f + pf * pf) THEN 'indistinguishable' WHEN m > pm THEN 'regressed' ELSE 'improved' END AS verdict
    FROM l
    """,
)
def epoch_lag_compare(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 6).alias("epoch"), "value")
    epochs = points.groupBy("run", "epoch").agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.lit(1.96) * F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("f"))
    full = epochs.withColumn("fullest", F.max("n").over(Window.partitionBy("run"))).where(F.col("n") >= F.greatest(F.lit(10), F.floor(F.col("fullest") * 0.8)))
    order = Window.partitionBy("run").orderBy("epoch")
    lagged = full.withColumn("pm", F.lag("m").over(order)).withColumn("pf", F.lag("f").over(order))
    d, t = F.col("m") - F.col("pm"), S.RESOLVE * F.sqrt(F.col("f") * F.col("f") + F.col("pf") * F.col("pf"))
    word = F.when(F.col("pm").isNotNull(), S.verdict(d, t))
    return lagged.select("run", "epoch", "n", F.round("m", 6).alias("mean"), F.round(d, 6).alias("difference"), F.round(t, 6).alias("threshold"), word.alias("verdict"))


@register(
    "run_carry_forward",
    """
    WITH l AS (SELECT o_custkey % 10 AS file, o_orderkey AS line, CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority END AS label FROM orders)
    SELECT file, line, last_value(label IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l
    """,
)
def run_carry_forward(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderpriority"))
    lines = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("file"), F.col("o_orderkey").alias("line"), label.alias("label"))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("file", "line", F.last("label", ignorenulls=True).over(order).alias("run"))


@register(
    "training_windows",
    """
    WITH t AS (SELECT event_type, max(event_id) AS total FROM events GROUP BY event_type)
    SELECT e.event_type, f.f AS fraction, count(*) AS n, round(avg(value), 6) AS mean FROM events e JOIN t USING (event_type), (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) f(f)
    WHERE e.event_id >= floor(f.f * total) AND e.event_id < floor(f.f * total) + 3000 GROUP BY ALL
    """,
)
def training_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("event_type").agg(F.max("event_id").alias("total"))
    starts = totals.withColumn("fraction", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))).withColumn("start", F.floor(F.col("fraction") * F.col("total")))
    rows = events.join(starts, "event_type").where((F.col("event_id") >= F.col("start")) & (F.col("event_id") < F.col("start") + 3000))
    return rows.groupBy("event_type", "fraction").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "adjacent_sets",
    """
    WITH s AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
    SELECT day, n, round(lead(m) OVER (ORDER BY day) - m, 6) AS step FROM s
    """,
)
def adjacent_sets(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"))
    return days.select("day", "n", F.round(F.lead("m").over(Window.orderBy("day")) - F.col("m"), 6).alias("step"))


@register(
    "stage_latency",
    """
    WITH t AS (SELECT event_id // 10 AS turn, event_type AS stage, sum(value) AS ms FROM events GROUP BY ALL),
    a AS (SELECT turn, sum(ms) AS total, count(*) AS stages FROM t GROUP BY turn)
    SELECT stage, count(*) AS turns, round(list_sort(list(ms))[1 + (count(*) // 2)::INT], 6) AS upper_median, (SELECT count(*) FROM a) - count(*) AS absent,
           round((SELECT list_sort(list(total))[1 + least(floor(0.95 * count(*)), count(*) - 1)::INT] FROM a), 6) AS total_p95
    FROM t GROUP BY stage
    """,
)
def stage_latency(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 10).alias("turn"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("ms"))
    t = cut(t)  # sums of doubles may differ by their order, and each is read several times
    whole = cut(t.groupBy("turn").agg(F.sum("ms").alias("total")))
    totals = Q.at_ranks(whole.withColumn("all_", F.lit(0)), "all_", "total", {"p95": Q.capped_rank(F.col("n"), 0.95)}).select("p95")
    counted = whole.agg(F.count("*").alias("all_turns"))
    stages = t.groupBy("stage").agg(F.count("*").alias("turns"))
    middle = Q.at_ranks(t, "stage", "ms", {"upper": Q.upper_rank(F.col("n"))}).select(F.col("stage").alias("stage_"), "upper")
    placed = stages.join(middle, F.col("stage").eqNullSafe(F.col("stage_")), "left")
    both = placed.join(F.broadcast(counted)).join(F.broadcast(totals))  # two tables of one row
    return both.select("stage", "turns", F.round("upper", 6).alias("upper_median"), (F.col("all_turns") - F.col("turns")).alias("absent"), F.round("p95", 6).alias("total_p95"))


@register(
    "turn_taking_curve",
    """
    WITH s AS (SELECT length(text) / 4.67 AS sec FROM conversations WHERE role = 'assistant')
    SELECT t.t AS t, round(avg((sec > t.t)::INT::DOUBLE), 9) AS unfinished, round(median(least(t.t / nullif(sec, 0), 1.0::DOUBLE)), 6) AS heard FROM s, (VALUES (3), (5), (10), (15), (30)) t(t) GROUP BY t.t
    """,
)
def turn_taking_curve(spark, sf_dir):
    spoken = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.length("text") / 4.67).alias("sec"))
    rows = spoken.select("sec", F.explode(F.array(*[F.lit(x) for x in (3, 5, 10, 15, 30)])).alias("t"))
    heard = F.least(F.try_divide(F.col("t"), F.col("sec")), F.lit(1.0))
    return rows.groupBy("t").agg(F.round(F.avg((F.col("sec") > F.col("t")).cast("double")), 9).alias("unfinished"), F.round(F.median(heard), 6).alias("heard"))


@register(
    "multiturn_summary",
    "SELECT turn, count(*) AS n, round(median(length(text)), 6) AS median_chars, count(*) FILTER (length(trim(text)) = 0) AS empty FROM conversations WHERE role = 'assistant' GROUP BY turn",
)
def multiturn_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.round(F.median(F.length("text")), 6).alias("median_chars"), F.count_if(F.length(F.trim("text")) == 0).alias("empty"))


@register(
    "mos_two_ways",
    """
    WITH r AS (SELECT l_suppkey % 40 AS clip, l_linenumber AS rater, l_quantity / 10.0::DOUBLE AS mos FROM lineitem), c AS (SELECT clip, avg(mos) AS m FROM r GROUP BY clip)
    SELECT round((SELECT avg(mos) FROM r), 6) AS pooled, round(avg(m), 6) AS by_clip, count(*) AS clips FROM c
    """,
)
def mos_two_ways(spark, sf_dir):
    ratings = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("clip"), (F.col("l_quantity") / 10.0).alias("mos"))
    clips = ratings.groupBy("clip").agg(F.avg("mos").alias("m"), F.sum("mos").alias("s"), F.count("*").alias("k"))
    return clips.agg(F.round(F.sum("s") / F.sum("k"), 6).alias("pooled"), F.round(F.avg("m"), 6).alias("by_clip"), F.count("*").alias("clips"))


@register(
    "rater_consistency",
    """
    WITH r AS (SELECT o_custkey % 20 AS rater, o_custkey AS token, o_totalprice AS mos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    p AS (SELECT rater, token, max(mos) FILTER (k = 1) AS a, max(mos) FILTER (k = 2) AS b FROM r GROUP BY ALL)
    SELECT rater, count(*) AS repeats, round(avg(abs(a - b)), 4) AS mean_gap FROM p WHERE b IS NOT NULL GROUP BY rater
    """,
)
def rater_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), 1, 2).alias("x"))
    gap = F.abs(F.element_at("x", 1)["o_totalprice"] - F.element_at("x", 2)["o_totalprice"])
    return rows.where(F.size("x") == 2).groupBy((F.col("o_custkey") % 20).alias("rater")).agg(F.count("*").alias("repeats"), F.round(F.avg(gap), 4).alias("mean_gap"))


@register(
    "synthesis_efficiency",
    f"""WITH s AS ({_SORTED})
    SELECT event_type, n, round(x[1 + (n // 2)::INT], 6) AS median_ms, CASE WHEN n >= 20 THEN round(x[1 + greatest(floor(0.95 * n) - 1, 0)::INT], 6) END AS p95_ms,
           round(list_sum(x) / 1000 / (n * 0.2), 6) AS real_time_factor FROM s""",
)
def synthesis_efficiency(spark, sf_dir):
    n = F.col("n")
    found = _at_ranks(spark, sf_dir, {"median": Q.upper_rank(n), "p95": Q.minus_one_rank(n, 0.95)})
    totals = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type_")).agg(F.sum("value").alias("total"))
    both = found.join(totals, F.col("event_type").eqNullSafe(F.col("type_")))
    return both.select(
        "event_type", "n", F.round("median", 6).alias("median_ms"), F.when(n >= 20, F.round("p95", 6)).alias("p95_ms"), F.round(F.col("total") / 1000 / (n * 0.2), 6).alias("real_time_factor")
    )


@register(
    "sampling_sharpness",
    """
    WITH s AS (SELECT l_linenumber AS layer, l_discount * 10 AS top1, (l_returnflag = 'N') AS agree FROM lineitem), g AS (SELECT layer, median(top1) AS m, avg(agree::INT::DOUBLE) AS a FROM s GROUP BY layer)
    SELECT layer, round(m, 6) AS median_top1, round(a, 9) AS agreement, m >= 0.95 AS inert, round(avg(a) OVER (), 9) AS mean_agreement FROM g
    """,
)
def sampling_sharpness(spark, sf_dir):
    layers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("layer")).agg(F.median(F.col("l_discount") * 10).alias("m"), F.avg((F.col("l_returnflag") == "N").cast("double")).alias("a"))
    return layers.select("layer", F.round("m", 6).alias("median_top1"), F.round("a", 9).alias("agreement"), (F.col("m") >= 0.95).alias("inert"), F.round(F.avg("a").over(Window.partitionBy()), 9).alias("mean_agreement"))


@register(
    "peak_normalised",
    """
    WITH p AS (SELECT l_shipmode AS arm, x FROM (SELECT l_returnflag AS l_shipmode, l_quantity * 655.36 AS x FROM lineitem))
    SELECT arm, round(quantile_cont(x, 0.5), 4) AS p50, round(max(x), 4) AS p100, abs(quantile_cont(x, 0.5) / 31129.6 - 1) <= 0.02 AND abs(max(x) / 31129.6 - 1) <= 0.02 AS normalised FROM p GROUP BY arm
    """,
)
def peak_normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), (F.col("l_quantity") * 655.36).alias("x"))
    target = 0.95 * 32768
    p50, p100 = F.percentile("x", F.lit(0.5)), F.max("x")
    fine = (F.abs(p50 / target - 1) <= 0.02) & (F.abs(p100 / target - 1) <= 0.02)
    return rows.groupBy("arm").agg(F.round(p50, 4).alias("p50"), F.round(p100, 4).alias("p100"), fine.alias("normalised"))


@register(
    "arm_intersection",
    """
    WITH u AS (SELECT user_id, count(DISTINCT event_type) AS arms FROM events GROUP BY user_id), n AS (SELECT count(DISTINCT event_type) AS n FROM events)
    SELECT user_id, arms = (SELECT n FROM n) AS kept FROM u
    """,
)
def arm_intersection(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    arms = events.select("event_type").distinct().agg(F.count("*").alias("n"))
    users = events.groupBy("user_id").agg(F.countDistinct("event_type").alias("arms"))
    return users.join(F.broadcast(arms)).select("user_id", (F.col("arms") == F.col("n")).alias("kept"))


@register(
    "prosody_by_axis",
    """
    WITH l AS (SELECT event_type AS arm, user_id AS id, avg(value) AS level, max(value) - min(value) AS spread FROM events GROUP BY ALL),
    x AS (SELECT arm, id, 'level' AS axis, level AS v FROM l UNION ALL SELECT arm, id, 'spread', spread FROM l),
    b AS (SELECT id, axis, v FROM x WHERE arm = (SELECT min(event_type) FROM events)),
    d AS (SELECT x.arm, x.axis, x.v - b.v AS d FROM x JOIN b USING (id, axis) WHERE x.arm <> (SELECT min(event_type) FROM events))
    SELECT arm, axis, count(*) AS n, round(avg(d), 6) AS difference, abs(avg(d)) <= 3 * 1.96 * stddev_samp(d) / sqrt(count(*)) AS indistinguishable FROM d GROUP BY ALL
    """,
)
def prosody_by_axis(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    wide = events.groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("id")).agg(F.avg("value").alias("level"), (F.max("value") - F.min("value")).alias("spread"))
    long = wide.unpivot(["arm", "id"], ["level", "spread"], "axis", "v")
    base = events.agg(F.min("event_type").alias("base"))
    marked = long.join(F.broadcast(base))
    first = marked.where("arm = base").select("id", "axis", F.col("v").alias("b"))
    d = marked.where("arm <> base").join(first, ["id", "axis"]).select("arm", "axis", (F.col("v") - F.col("b")).alias("d"))
    line = S.RESOLVE * F.lit(1.96) * F.stddev_samp("d") / F.sqrt(F.count("*"))
    return d.groupBy("arm", "axis").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("difference"), (F.abs(F.avg("d")) <= line).alias("indistinguishable"))


@register(
    "chunk_latency_rounds",
    """
    WITH r AS (SELECT user_id AS round, event_type AS arm, avg(value) AS ms, min(event_id % 7) AS text FROM events GROUP BY ALL),
    k AS (SELECT round FROM r GROUP BY round HAVING count(DISTINCT text) = 1), b AS (SELECT round, ms FROM r WHERE arm = (SELECT max(event_type) FROM events))
    SELECT r.arm, count(*) AS rounds, round(avg(r.ms - b.ms), 6) AS delta FROM r JOIN k USING (round) JOIN b USING (round) GROUP BY r.arm
    """,
)
def chunk_latency_rounds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    r = events.groupBy(F.col("user_id").alias("round"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("ms"), F.min(F.col("event_id") % 7).alias("text"))
    kept = r.groupBy("round").agg(F.countDistinct("text").alias("texts")).where("texts = 1").select("round")
    base = events.agg(F.max("event_type").alias("base"))
    same = r.join(kept, "round").join(F.broadcast(base))
    first = same.where("arm = base").select("round", F.col("ms").alias("b"))
    return same.join(first, "round").groupBy("arm").agg(F.count("*").alias("rounds"), F.round(F.avg(F.col("ms") - F.col("b")), 6).alias("delta"))


@register(
    "instrument_checks",
    """
    WITH v AS (SELECT o_custkey AS item, o_orderkey % 3 AS arm, (o_totalprice > 150000)::INT AS yes FROM orders),
    m AS (SELECT item, arm, sum(yes) * 2 > count(*) AS answer FROM v GROUP BY ALL),
    p AS (SELECT a.item, a.answer AS own, b.answer AS again, c.answer AS shuffled FROM m a JOIN m b ON a.item = b.item AND b.arm = 1 JOIN m c ON a.item = c.item AND c.arm = 2 WHERE a.arm = 0)
    SELECT count(*) AS n, round(avg((own = again)::INT::DOUBLE), 9) AS invariance, round(avg(shuffled::INT::DOUBLE), 9) AS shuffled_rate,
           avg((own = again)::INT::DOUBLE) >= 0.95 AND avg(shuffled::INT::DOUBLE) <= 0.30 AND abs(avg(own::INT::DOUBLE) - avg(shuffled::INT::DOUBLE)) > 3 * 1.96 * sqrt(0.25 / count(*)) AS valid FROM p
    """,
)
def instrument_checks(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 3).alias("arm"), (F.col("o_totalprice") > 150000).cast("int").alias("yes"))
    answer = F.sum("yes") * 2 > F.count("yes")
    wide = votes.groupBy("item").pivot("arm", [0, 1, 2]).agg(answer).toDF("item", "own", "again", "shuffled").where("own IS NOT NULL AND again IS NOT NULL AND shuffled IS NOT NULL")
    same, shuffled = F.avg((F.col("own") == F.col("again")).cast("double")), F.avg(F.col("shuffled").cast("double"))
    apart = F.abs(F.avg(F.col("own").cast("double")) - shuffled) > S.RESOLVE * S.binomial_noise(F.count("*"))
    return wide.agg(F.count("*").alias("n"), F.round(same, 9).alias("invariance"), F.round(shuffled, 9).alias("shuffled_rate"), ((same >= 0.95) & (shuffled <= 0.30) & apart).alias("valid"))
