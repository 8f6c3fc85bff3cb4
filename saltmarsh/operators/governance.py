"""Rule scans, JSON scrubbing, provenance and traceability."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (name, pattern) of what may not stand in a released line, letters in either case.
CONTENT_RULES = (
    ("personal_path", r"/home/[A-Za-z0-9_-]+|/Users/[A-Za-z0-9_-]+|[A-Za-z]:[\\/]{1,2}(?:Users|UserData|home)\b"),
    ("merge_conflict", r"^<{7}(\s|$)|^>{7}(\s|$)"),
    ("internal_address", r"\b(?:192\.168\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b"),
    ("credential", r"BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|DPAPI"),
)
#: Fixed values: (name, pattern) of file names that may not be released.
PATH_RULES = (("large_asset", r"\.(pth|pt|ckpt|safetensors|bin|parquet|wav|mp3|flac|env|key|pem)$"),)


def scan_lines(files: DataFrame, path: str, text: str, rules=CONTENT_RULES, exempt: list[str] = (), exempt_rule: dict[str, str] | None = None) -> DataFrame:
    """(path, line, rule) of every line that a rule finds.

    ``exempt`` paths are not scanned; ``exempt_rule`` names, for a rule, a pattern of paths it passes over.
    """
    rows = files.where(~F.col(path).isin(list(exempt))) if exempt else files
    lines = rows.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("at", "body"))

    def found(name: str, pattern: str) -> Column:
        hit = F.col("body").rlike(f"(?i){pattern}")
        if exempt_rule and name in exempt_rule:
            hit = hit & ~F.col("path").rlike(exempt_rule[name])
        return F.when(hit, F.lit(name))

    names = F.array_compact(F.array(*[found(n, p) for n, p in rules]))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(names).alias("rule"))


def scan_paths(files: DataFrame, path: str, rules=PATH_RULES) -> DataFrame:
    """(path, rule) of every name that a rule finds."""
    names = F.array_compact(F.array(*[F.when(F.col(path).rlike(f"(?i){p}"), F.lit(n)) for n, p in rules]))
    return files.select(F.col(path).alias("path"), F.explode(names).alias("rule"))


def claims_without_negation(files: DataFrame, path: str, text: str, phrase: str, negators: tuple[str, ...]) -> DataFrame:
    """(path, line) of the lines that make a claim and do not deny it."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "body"))
    keep = F.col("body").contains(phrase)
    for word in negators:
        keep = keep & ~F.col("body").contains(word)
    return lines.where(keep).select("path", (F.col("at") + 1).alias("line"))


def untraceable(claims: DataFrame, listing: DataFrame, source: str, path: str) -> DataFrame:
    """(claim rows) whose sources name a path that is not there: comma-separated, first word, with a slash."""
    named = claims.withColumn("named", F.explode(F.split(source, ","))).withColumn("named", F.element_at(F.split(F.trim("named"), " "), 1))
    return named.where(F.col("named").contains("/")).join(listing.select(F.col(path).alias("named")).distinct(), "named", "left_anti")


def scrubbed(documents: Column, prose: tuple[str, ...] = (), home: str = r"^(?:/home/|/Users/|[A-Za-z]:[\\/]{1,2}(?:Users|UserData|home)[\\/])") -> Column:
    """JSON texts with personal paths cut to their base names, but not in prose fields or values with spaces."""
    import re

    personal, last = re.compile(home, re.IGNORECASE), re.compile(r"[^/\\]*$")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def visit(x, name=None):
            if isinstance(x, dict):
                return {k: visit(v, k) for k, v in x.items()}
            if isinstance(x, list):
                return [visit(v, name) for v in x]
            if isinstance(x, str) and name not in prose and not re.search(r"\s", x) and personal.match(x):
                return last.search(x).group()
            return x

        return texts.map(lambda t: None if t is None else json.dumps(visit(json.loads(t)), ensure_ascii=False, sort_keys=True))

    return run(documents)


def verbatim_members(references: DataFrame, turns: DataFrame, text: str) -> DataFrame:
    """The references that stand, letter for letter, among training turns."""
    return references.join(turns.select(F.col(text)).distinct(), text, "left_semi")


def membership_refused(members: Column, n: Column) -> Column:
    """Whether too many references are training turns (more than a twentieth)."""
    return members > F.floor(n / 20)


def similar_ratio(a: Column, b: Column) -> Column:
    """The matching-blocks ratio of two texts (as difflib has it, with its treatment of frequent characters)."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def verbatim(a: Column, b: Column, least: float = 0.95, length: int = 20) -> Column:
    """Whether a reply repeats a reference: long enough, and alike enough."""
    return (F.length(b) >= length) & (similar_ratio(a, b) >= least)


def required(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, once every one meets ``condition``; a row that does not stops the job with ``message``."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows, once no key repeats or is missing."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(key))
    return required(rows.withColumn("n_", n), (F.col("n_") == 1) & F.col(key).isNotNull(), f"{key} is missing or repeats").drop("n_")


def one_value(rows: DataFrame, column: str, what: str) -> DataFrame:
    """The rows, once they agree on ``column`` (one checkpoint, one judge)."""
    from pyspark.sql import Window

    every = Window.partitionBy()
    return required(rows.withColumn("lo_", F.min(column).over(every)).withColumn("hi_", F.max(column).over(every)), F.col("lo_").eqNullSafe(F.col("hi_")), f"more than one {what}").drop("lo_", "hi_")


def health(parts: DataFrame, ready: str) -> DataFrame:
    """unavailable, degraded or ready, from the parts' own states."""
    state = F.when(F.count("*") == 0, "unavailable").when(F.bool_and(ready), "ready").when(F.bool_or(ready), "degraded").otherwise("unavailable")
    return parts.agg(state.alias("state"), F.count("*").alias("parts"), F.count_if(F.col(ready)).alias("ready"))
