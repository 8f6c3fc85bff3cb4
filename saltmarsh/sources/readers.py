"""Sources and sinks: corpora by row group, JSON and JSONL documents, rater sheets, logs, trees of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saltmarsh.operators.governance import required

#: A row group beyond this is refused, as a reader holds a whole one.
MAX_GROUP_BYTES = 512 << 20
#: Stores whose files are opened by range.
RANGED = ("file", "hdfs")


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, num_rows, total_byte_size, offset) from the footers alone.

    Files are listed by Spark, without their content, and executors read the last bytes of each by range, of any
    size of file. That goes for the schemes of ``RANGED``; files of other stores are read as Spark's binary source
    gives them, so these must be no larger than one task may hold. Offsets run over files by name, groups in order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    ranged = F.regexp_extract("path", r"^([A-Za-z][\w+.-]*):", 1).isin(*RANGED)
    listed = files.where(ranged).select("path", F.lit(None).cast("binary").alias("content"))
    # A file list is dealt by size, which footers do not depend on.
    files = listed.repartition(spark.sparkContext.defaultParallelism).unionByName(files.where(~ranged).select("path", "content"))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote, urlsplit

        import pyarrow.parquet as pq
        from pyarrow import fs

        def opened(name: str, body: pa.Scalar):
            if body.is_valid:
                return pa.BufferReader(body.as_buffer())
            if (at := urlsplit(name)).scheme == "file":
                return fs.LocalFileSystem().open_input_file(unquote(at.path))
            store, inner = fs.FileSystem.from_uri(name)
            return store.open_input_file(inner)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                with opened(name, body) as source:
                    meta = pq.ParquetFile(source).metadata
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(groups), pa.string()), pa.array(range(len(groups)), pa.int32()), pa.array([g.num_rows for g in groups], pa.int64()), pa.array([g.total_byte_size for g in groups], pa.int64())],
                    ["file", "row_group", "num_rows", "total_byte_size"],
                )

    found = files.mapInArrow(footers, "file string, row_group int, num_rows long, total_byte_size long")
    before = Window.orderBy("file", "row_group").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))


def described(groups: DataFrame) -> DataFrame:
    """(rows, groups, largest) of a corpus."""
    return groups.agg(F.sum("num_rows").alias("rows"), F.count("*").alias("groups"), F.max("num_rows").alias("largest"))


def checked_groups(groups: DataFrame, limit: int = MAX_GROUP_BYTES) -> DataFrame:
    """The groups, once none is too large to hold."""
    return required(groups, F.col("total_byte_size") <= limit, "a row group is too large; repartition the file first")


def located(groups: DataFrame, indices: DataFrame, index: str) -> DataFrame:
    """(index, file, row_group, within) of global row numbers; negative ones count from the end, others out of range stop the job.

    Row numbers and groups meet by stretches as long as the mean group: a group is listed under each stretch that it
    reaches into, about two on average, so the join is by equal keys and a number meets few groups.
    """
    total = groups.agg(F.coalesce(F.sum("num_rows"), F.lit(0)).alias("total_"), F.greatest(F.ceil(F.avg("num_rows")), F.lit(1)).alias("width_"))
    whole = indices.join(F.broadcast(total)).withColumn("at_", F.when(F.col(index) < 0, F.col(index) + F.col("total_")).otherwise(F.col(index)))
    fine = required(whole, (F.col("at_") >= 0) & (F.col("at_") < F.col("total_")), "a row number is out of range")
    last = F.col("offset") + F.col("num_rows") - 1
    reached = F.sequence(F.floor(F.col("offset") / F.col("width_")), F.floor(last / F.col("width_")))
    listed = groups.where("num_rows > 0").join(F.broadcast(total)).select("file", "row_group", "num_rows", "offset", F.explode(reached).alias("stretch_"))
    inside = (F.col("at_") >= F.col("offset")) & (F.col("at_") < F.col("offset") + F.col("num_rows"))
    asked = fine.withColumn("stretch_", F.floor(F.col("at_") / F.col("width_")))
    return asked.join(listed, "stretch_").where(inside).select(index, "file", "row_group", (F.col("at_") - F.col("offset")).alias("within"))


def repartitioned(spark: SparkSession, source: str, target: str, rows_per_group: int = 4096) -> DataFrame:
    """Rewrite a corpus in row groups of ``rows_per_group`` rows, the last of a file what is left; snappy.

    Stops if the row count changed. The Parquet writer closes a group at that many rows, or earlier at its size limit.
    """
    rows = spark.read.parquet(source)
    rows.write.option("compression", "snappy").option("parquet.block.row.count.limit", rows_per_group).parquet(target)
    out = spark.read.schema(rows.schema).parquet(target)
    before, after = rows.count(), out.count()
    if before != after:
        raise ValueError(f"{source} has {before} rows, {target} has {after}")
    return out


def one_row_copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A corpus of the same schema with one row of the source, as a stand-in for readers that need a file."""
    rows = spark.read.parquet(source)
    rows.limit(1).write.parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, required_fields: tuple[str, ...] = (), partial: bool = False) -> DataFrame:
    """Rows of a JSONL file: blank lines skipped, unknown fields ignored, required fields checked.

    ``partial`` drops a line cut short (an interrupted writer's last one); else such a line stops the job.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if partial else "FAILFAST").json(path)
    for name in required_fields:
        rows = required(rows, F.col(name).isNotNull(), f"a row has no {name}")
    return rows


def read_documents(spark: SparkSession, path: str, schema: StructType | str, rows: str) -> DataFrame:
    """The array ``rows`` of JSON documents, a row each, beside the documents' other fields."""
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    return docs.select("*", F.explode(rows).alias("row")).drop(rows).select("*", "row.*").drop("row")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rater sheets as CSV, with the rater's number and the folder from the file's name.

    The byte-order mark goes with the header. Workbooks without a CSV beside them are read by ``read_workbooks``.
    """
    sheets = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    clean = [F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in sheets.columns]
    name = F.input_file_name()
    return sheets.select(*clean, F.regexp_extract(name, r"(?i)rater\s*(\d+)", 1).cast("int").alias("rater"), F.regexp_extract(name, r"([^/]+)/[^/]*$", 1).alias("folder"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(folder, rater, line, cells) of the first sheet of every rater's workbook that has no CSV beside it.

    A workbook is a ZIP of XML: cells hold numbers or point into a table of shared strings. ``cells`` maps a
    column's letters to its text. Where ``name.csv`` stands in the same folder, that is the sheet and the workbook is left out.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    csv = names.where(F.lower("path").endswith(".csv")).select(stem.alias("stem")).distinct()
    books = names.where(F.lower("path").endswith(".xlsx")).select(stem.alias("stem"), "path", "content").join(csv, "stem", "left_anti").select("path", "content")

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for batch in batches:
            out: list[list] = [[], [], []]
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                book = zipfile.ZipFile(io.BytesIO(body.as_py()))
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = ["".join(t.text or "" for t in item.iter(f"{main}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                first = min(x for x in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x))
                for row in ElementTree.fromstring(book.read(first)).iter(f"{main}row"):
                    cells = []
                    for cell in row.iter(f"{main}c"):
                        value, inner = cell.find(f"{main}v"), cell.find(f"{main}is")
                        text = "".join(t.text or "" for t in inner.iter(f"{main}t")) if inner is not None else value.text if value is not None else None
                        cells.append((re.sub(r"\d", "", cell.get("r")), shared[int(text)] if cell.get("t") == "s" else text))
                    for values, x in zip(out, (name, int(row.get("r")), cells)):
                        values.append(x)
            kinds = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["path", "line", "cells"])

    rows = books.mapInArrow(sheets, "path string, line int, cells map<string,string>")
    rater = F.regexp_extract("path", r"(?i)rater\s*(\d+)", 1).cast("int")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("folder"), rater.alias("rater"), "line", "cells")


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples) of 16-bit PCM files, samples from -1 to 1; other widths are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                with wave.open(io.BytesIO(body.as_py())) as sound:
                    if sound.getsampwidth() != 2:
                        raise ValueError(f"{name} is not 16-bit")
                    x = np.frombuffer(sound.readframes(sound.getnframes()), "<i2") / 32768.0
                    columns = [pa.array([name]), pa.array([sound.getframerate()], pa.int32()), pa.array([sound.getnchannels()], pa.int32()), pa.array([x], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "rate", "channels", "samples"])

    return files.mapInArrow(opened, "path string, rate int, channels int, samples array<double>")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, run, epoch, step, steps, loss, text, audio, lr) of a training log.

    A banner ``===== label ...`` names the run of the lines after it, by its first word.
    """
    lines = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    label = F.nullif(F.regexp_extract("value", r"^=====\s+(\S+).*=====\s*$", 1), F.lit(""))
    run = F.last(label, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    point = r"Epoch:\[(\d+)/\d+\]\((\d+)/(\d+)\)"
    numbers = [F.regexp_extract("value", rf"\b{name}:\s*([-+.\deE]+)", 1) for name in ("loss", "text", "audio", "lr")]
    found = lines.withColumn("run", run).where(F.col("value").rlike(point))
    return found.select(
        "file", "line", "run",
        *[F.regexp_extract("value", point, k + 1).cast("int").alias(n) for k, n in enumerate(("epoch", "step", "steps"))],
        *[F.nullif(x, F.lit("")).cast("double").alias(n) for x, n in zip(numbers, ("loss", "text", "audio", "lr"))],
    )


def read_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under a folder, or of one file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files beside the record ``<file>.provenance.json`` of each, null where there is none."""
    side = sidecars.select(F.regexp_replace("path", r"\.provenance\.json$", "").alias("path"), F.col("content").cast("string").alias("provenance"))
    return files.join(side, "path", "left")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text a row, fields in order of their names, null fields left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).alias("value"))
