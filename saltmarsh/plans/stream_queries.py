"""Queries of the session logic, replayed over the batch tables, and one run as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.plans.core import register, table
from saltmarsh.session import scratch_dir
from saltmarsh.streaming import sessions as S


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "text")


@register(
    "context_stream",
    """
    WITH c AS (SELECT conv_id, turn, (floor(length(text) / 1.5) + 1)::BIGINT AS cost FROM conversations),
    u AS (SELECT a.conv_id, a.turn, min(b.turn) AS at FROM c a JOIN (SELECT x.conv_id, x.turn, y.turn AS old, sum(z.cost) AS s FROM c x JOIN c y ON x.conv_id = y.conv_id AND y.turn < x.turn JOIN c z ON z.conv_id = x.conv_id AND z.turn BETWEEN y.turn AND x.turn GROUP BY ALL) b
          ON a.conv_id = b.conv_id AND b.old = a.turn AND b.s > 400 GROUP BY ALL)
    SELECT conv_id::VARCHAR AS session, at AS seq, 'dropped' AS kind, turn::VARCHAR AS value FROM u
    """.replace(" AS at", " AS pos").replace("at AS seq", "pos AS seq"),
)
def context_stream(spark, sf_dir):
    return S.replay(_turns(spark, sf_dir), lambda state, event: S.context_step(state, event, 400))


@register("clause_stream")
def clause_stream(spark, sf_dir):
    """Every turn's text arrives in deltas of seven characters, then the end."""
    turns = table(spark, sf_dir, "conversations")
    session = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    n = F.ceil(F.length("text") / 7).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.cast("long").alias("seq"), F.when(k < n, F.substr("text", k * 7 + 1, F.lit(7))).alias("delta")))
    return S.replay(turns.select(session.alias("session"), F.explode(parts).alias("e")).select("session", "e.*"), S.clause_step)


@register("endpoint_stream")
def endpoint_stream(spark, sf_dir):
    """Each user's events as frames: blocks of loud and quiet frames in turn."""
    frames = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(F.floor(F.col("event_id") / 3000) % 2 == 0, 0.1).otherwise(0.001).alias("energy"))
    return S.replay(frames, S.endpoint_step)


@register(
    "chunk_stream",
    """
    WITH n AS (SELECT vec_id::VARCHAR AS session, len(embedding) AS n FROM embeddings), c AS (SELECT session, n, unnest(range(0, n // 4)) AS k FROM n)
    SELECT session, (4 * k + 3)::BIGINT AS seq, 'chunk' AS kind, (4 * k - least(2, 4 * k)) || ':' || (4 * k + 4) AS value FROM c
    UNION ALL SELECT session, n::BIGINT, 'final', CASE WHEN n % 4 = 0 THEN '' ELSE ((n // 4) * 4 - least(2, (n // 4) * 4)) || ':' || n END FROM n
    """,
)
def chunk_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    n = F.size("embedding")
    frames = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.cast("long").alias("seq"), F.when(k < n, F.lit(1)).alias("frame")))
    return S.replay(rows.select(F.col("vec_id").cast("string").alias("session"), F.explode(frames).alias("e")).select("session", "e.*"), S.chunk_step)


_TYPES = ("input_audio_buffer.append", "input_audio_buffer.commit", "response.cancel", "response.done", "response.audio.delta", "session.update", "input_audio_buffer.clear")


def _realtime(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") % 50).cast("int").alias("size"))


@register("realtime_events")
def realtime_events(spark, sf_dir):
    return S.replay(_realtime(spark, sf_dir), S.realtime_step)


@register(
    "frames_in_flight",
    """
    WITH e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, event_id % 7 AS t FROM events),
    w AS (SELECT *, coalesce(sum((t = 2)::INT) OVER o, 0) AS c, coalesce(sum((t = 3)::INT) OVER o, 0) AS d FROM e WINDOW o AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT session, count(*) FILTER (c > 0 AND d = 0 AND t = 4) AS frames FROM w GROUP BY session
    """,
)
def frames_in_flight(spark, sf_dir):
    return S.frames_in_flight(_realtime(spark, sf_dir))


@register(
    "event_windows",
    "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def event_windows(spark, sf_dir):
    out = S.event_windows(table(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("context_structured_stream", "SELECT conv_id::VARCHAR AS session, count(*) AS dropped FROM (SELECT conv_id, sum(floor(length(text) / 1.5) + 1) OVER w - 0 AS upto, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE upto > 400 AND rn > 1 GROUP BY 1")
def context_structured_stream(spark, sf_dir):
    """The context operator as a stream over the table's file, its output kept as files in the shared folder."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = scratch_dir(spark)
    source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations*.parquet")
    turns = source.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "text")
    found = S.stream(turns, lambda state, event: S.context_step(state, event, 400))
    query = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{path}/out")
    return out.groupBy("session").agg(F.count("*").alias("dropped"))
