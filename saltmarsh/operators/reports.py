"""Reports and provenance: what was measured, by whom, and what may not be claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.stats import RESOLVE, verdict
from saltmarsh.functions.text import basename, cosine
from saltmarsh.operators.governance import required

#: Width of a speaker vector, and the least length of its reference codes.
SPEAKER_WIDTH, REFERENCE_CODES = 192, 480


def measurement_listing(reports: DataFrame, measurements: str = "measurements") -> DataFrame:
    """One row a measurement of documents that hold a map of them, marked by whether it may gate."""
    rows = reports.select("*", F.explode(measurements).alias("name", "m")).drop(measurements)
    mark = F.when(F.col("m.gating_eligible"), "gates").otherwise("reported only")
    return rows.select(*[c for c in rows.columns if c not in ("name", "m")], "name", "m.value", "m.noise_floor", "m.sample_size", mark.alias("mark"), "m.note")


def not_claimed(measurements: DataFrame, group: str) -> DataFrame:
    """Per report the names, in order, of what may not gate."""
    names = F.collect_list(F.when(~F.col("gating_eligible"), F.col("name")))
    return measurements.groupBy(group).agg(F.sort_array(names).alias("not_claimed"), F.count("*").alias("measured"))


def transcribed(rows: DataFrame, flag: str = "transcribed") -> DataFrame:
    """The rows, failures among them, unless there are rows and none succeeded."""
    from pyspark.sql import Window

    any_ = F.coalesce(F.bool_or(flag).over(Window.partitionBy()), F.lit(False))
    return required(rows.withColumn("any_", any_), F.col("any_"), "nothing was transcribed").drop("any_")


def repointed(manifests: DataFrame, target: str, codec: str, samples: str = "samples", path: str = "audio_path") -> DataFrame:
    """Manifests whose samples point to their base names under ``target``, stamped with the codec's digest."""
    moved = F.transform(samples, lambda s: s.withField(path, F.when(s[path].isNotNull(), F.concat(F.lit(target.rstrip("/") + "/"), basename(s[path])))))
    return manifests.withColumn(samples, moved).withColumn("codec", F.lit(codec))


def identity(voices: DataFrame, vector: str, control: str, reference: str, weak: float = 0.85) -> DataFrame:
    """Adds how much of a voice is kept against a control (0 where that has none), and whether it is weak."""
    kept, base = cosine(F.col(vector), F.col(reference)), cosine(F.col(control), F.col(reference))
    share = F.when(base > 0, kept / base).otherwise(F.lit(0.0))
    return voices.withColumn("identity", share).withColumn("weak", F.col("identity") < weak)


def usable_voices(rows: DataFrame, codes: str, embedding: str, width: int = SPEAKER_WIDTH, least: int = REFERENCE_CODES) -> DataFrame:
    """The rows with a speaker vector of the right width and reference codes enough."""
    return rows.where(F.col(codes).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) == width) & (F.size(codes) >= least))


def clone_report(candidate: DataFrame, reference: DataFrame, effects: tuple[float, float] = (0.05, 0.10)) -> DataFrame:
    """Per voice what a candidate changes on the clips (id, similarity, hit) that both sides have, and verdicts over all voices.

    A clip is named ``voice/clip``. (voice, clips, similarity, hits, similarity_verdict, hit_verdict): mean change of
    the similarity, change in the number of hits, and whether the mean changes of the voices tell the change from
    noise: voices are the units, since clips of one voice are no evidence of their own. More is better. With one
    voice the verdicts are null; clips of one side alone, and null ids, take no part.
    """
    both = candidate.select("id", F.col("similarity").alias("s1"), F.col("hit").cast("double").alias("h1")).join(reference.select("id", F.col("similarity").alias("s0"), F.col("hit").cast("double").alias("h0")), "id")
    changes = both.select(F.substring_index("id", "/", 1).alias("voice"), (F.col("s1") - F.col("s0")).alias("s"), (F.coalesce("h1", F.lit(0.0)) - F.coalesce("h0", F.lit(0.0))).alias("h"))
    voices = changes.groupBy("voice").agg(F.count("*").alias("clips"), F.avg("s").alias("similarity"), F.sum("h").alias("hits"), F.avg("h").alias("hit_rate"), F.sum("s").alias("total"), F.count("s").alias("scored"))
    line = RESOLVE * F.lit(1.96) / F.sqrt(F.count("*"))
    whole = voices.agg(
        (F.sum("total") / F.sum("scored")).alias("s_"), (F.stddev_samp("similarity") * line).alias("s_line"), (F.sum("hits") / F.sum("clips")).alias("h_"), (F.stddev_samp("hit_rate") * line).alias("h_line"),
    )
    judged = [F.when(F.col(f"{x}_line").isNotNull(), verdict(F.col(f"{x}_"), F.col(f"{x}_line"), False, effect)).alias(name) for x, effect, name in zip("sh", effects, ("similarity_verdict", "hit_verdict"))]
    return voices.join(F.broadcast(whole)).select("voice", "clips", "similarity", F.col("hits").cast("long").alias("hits"), *judged)  # one row is broadcast


def valid_pairs(candidate: DataFrame, reference: DataFrame, key: str, text: str, values: list[str], share: float = 0.8) -> DataFrame:
    """(key, values of the candidate, values of the reference as ``<name>_reference``) where pairing by key is valid, else no rows.

    Valid: two pairs or more, that cover ``share`` of the smaller side, and the same reference text on both sides of
    every pair; texts that differ would subtract unrelated numbers. Null and empty keys pair with nothing but
    count as rows of their side.
    """
    mine = candidate.select(F.col(key).alias("k_"), F.col(text).alias("t_"), *values)
    theirs = reference.select(F.col(key).alias("k_"), F.col(text).alias("u_"), *[F.col(v).alias(f"{v}_reference") for v in values])
    pairs = mine.where(F.col("k_").cast("string") != "").join(theirs, "k_")
    least = mine.agg(F.count("*").alias("a_")).join(theirs.agg(F.count("*").alias("b_")))
    seen = pairs.agg(F.count("*").alias("n_"), F.coalesce(F.bool_and(F.col("t_").eqNullSafe(F.col("u_"))), F.lit(False)).alias("same_"))
    enough = F.col("n_") >= F.greatest(F.lit(2), F.floor(share * F.least("a_", "b_")))
    gate = seen.join(least).where(F.col("same_") & enough).select(F.lit(True).alias("valid_"))
    return pairs.join(F.broadcast(gate)).select(F.col("k_").alias(key), *values, *[f"{v}_reference" for v in values])  # one row at most


def judge_provenance(model: str, endpoint: str, template: str) -> Column:
    """Who judged: model, endpoint and the digest of the prompt, never a key."""
    return F.struct(F.lit(model).alias("model"), F.lit(endpoint).alias("endpoint"), F.sha2(F.lit(template).cast("binary"), 256).alias("prompt_sha256"))


def classified(answer: Column, themes: list[str], other: str = "other") -> Column:
    """A theme of the closed set, or ``other``."""
    return F.when(F.trim(answer).isin(themes), F.trim(answer)).otherwise(F.lit(other))


def claimed_by_prefix(names: DataFrame, name: str, prefixes: dict[str, str], rest: str = "unclaimed") -> DataFrame:
    """Adds the group whose prefix a tensor's name has, the longest first; names of none are counted, not lost."""
    group = F.lit(rest)
    for prefix in sorted(prefixes, key=len):
        group = F.when(F.col(name).startswith(prefix), F.lit(prefixes[prefix])).otherwise(group)
    return names.withColumn("group", group)


def merged_weights(base: DataFrame, grafts: DataFrame, name: str) -> DataFrame:
    """The base's tensors with those of ``grafts`` in place of theirs, and the grafts it lacks."""
    return base.join(grafts.select(name), name, "left_anti").unionByName(grafts)


def shape_name(tensors: DataFrame, name: str, shape: str, pattern: str, widths: dict[int, str]) -> DataFrame:
    """The model size that the first matching tensor's width tells; unknown widths stop the job."""
    known = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    first = tensors.where(F.col(name).rlike(pattern)).agg(F.min_by(F.element_at(shape, -1), name).alias("width"))
    return required(first.withColumn("model", F.try_element_at(known, F.col("width"))), F.col("model").isNotNull(), "no known shape").select("model", "width")


def independent_judge(rows: DataFrame, judge: str, model: str, lineages: dict[str, str]) -> DataFrame:
    """The rows, unless a judge shares its lineage with the model it judges."""
    known = F.create_map(*[F.lit(x) for pair in lineages.items() for x in pair])
    own = F.try_element_at(known, F.col(judge))
    return required(rows, own.isNull() | ~own.eqNullSafe(F.try_element_at(known, F.col(model))), "the judge shares a lineage with the model")
