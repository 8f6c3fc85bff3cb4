"""Session factory and the scratch folder that every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "saltmarsh", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings that results depend on (UTC, ANSI, adaptive plans)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset on a local master (tests), a local
    temporary folder stands in, which goes when the program ends; elsewhere executors could not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="saltmarsh-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = "file://" + base
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/saltmarsh-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a write's shuffle files go as soon as it has ended: what it wrote is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches of the session hold ``most`` bytes, unless the session has a lower limit.

    Spark's own limit of 64 MB is for one buffer; a batch stands in several at once, in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "67108864b").lower().removesuffix("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > most:
        spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that later plans start from files.

    The files survive the loss of any executor, and the lineage ends there.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row as column ``name``, written so that every pass sees the same numbers."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))
