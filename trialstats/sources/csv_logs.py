"""Folder CSV scans with unlike headers.

Each participant's log is a CSV whose columns depend on the counterbalance, so
files in one folder have different headers (and even different column orders).
A single ``spark.read.csv(folder)`` takes the first header for all files and
assigns values **by position** — silently wrong. Here:

1. the files are listed, and tasks read the head of each file up to its first line
   end: bodies are not read, however large (``file_heads``; file systems that Python
   cannot open are scanned as text instead);
2. files are grouped by header, and each group is read with its own header (paths are
   metadata: Spark's reader keeps those of its input on the driver in any case);
3. the groups are stacked by name, missing columns as null (``unionByName``).

Every value stays text (no ``inferSchema``); types are applied later by the
explicit casts of ``functions.scalars``. Each row carries its provenance, the
file's full path and base name, and an order key ``(file_path, file_block_start,
seq)`` that sorts rows as they lie in the file (one split of a file is read by one
task, in order). Files of one name in two folders stay apart by their path; the
coding chain takes ``file_path`` as its file key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.operators.columns import clean_name

ORDER_KEY = ("file_path", "file_block_start", "seq")


HEAD_BLOCK = 1 << 14  # bytes read at once
PYTHON_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")


def read_head(stream: Any, block: int = HEAD_BLOCK) -> str:
    """First line of a byte stream, without its line end; reads blocks up to the first line end only."""
    head = b""
    while True:
        part = stream.read(block)
        head += part
        ends = [i for i in (head.find(b"\n"), head.find(b"\r")) if i >= 0]
        if ends or not part:
            return head[:min(ends)].decode("utf-8-sig") if ends else head.decode("utf-8-sig")


def open_path(uri: str) -> Any:
    """Input stream of a file by its URI, decompressed by its extension."""
    from pyarrow import fs
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        system, path = fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    else:
        system, path = fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
    return system.open_input_stream(path, compression="detect", buffer_size=None)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for uri in batch.column(0).to_pylist():
            with open_path(uri) as stream:
                found.append(read_head(stream))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["fp", "header"])


def _text_heads(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """Heads by a scan of all text, for file systems that only the JVM can open."""
    text = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
            .text(path)
            .select("value", F.col("_metadata.file_path").alias("fp"),
                    F.col("_metadata.file_block_start").alias("bs")))
    return (text.where(F.col("bs") == 0)
            .withColumn("seq", F.monotonically_increasing_id())
            .groupBy("fp").agg(F.min_by("value", "seq").alias("header")))


def file_heads(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(fp, header) of every file matched under ``path``, read by tasks from the files' heads.

    The list of files is that of the binary-file source, whose content column is not asked for.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("fp")))
    scheme = urlsplit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).getUri().toString()).scheme
    if scheme not in PYTHON_SCHEMES:
        return _text_heads(spark, path, glob, recursive)
    return files.mapInArrow(_heads, "fp string, header string")


def distinct_headers(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(header, files): the unlike headers of a folder and how many files have each, reduced on the executors."""
    return file_heads(spark, path, glob, recursive).groupBy("header").agg(F.count(F.lit(1)).alias("files"))


def file_headers(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> list[tuple[str, str]]:
    """(file path, header line) of every file matched under ``path``."""
    return [(r["fp"], r["header"]) for r in file_heads(spark, path, glob, recursive).collect()]


def stack_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing from one input is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_trials(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False,
                file_col: str | None = "file_name") -> DataFrame:
    """S1 + S2 + S3: all CSV logs of a folder as one text table, stacked by column name.

    Column names have dots replaced by underscores (rule 14). ``file_col`` keeps the
    source file name in front (S3); the order key columns are always added.
    """
    groups: dict[str, list[str]] = {}
    for fp, header in file_headers(spark, path, glob, recursive):
        groups.setdefault(header, []).append(fp)
    parts = []
    for files in groups.values():
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE").csv(sorted(files)))
        df = df.toDF(*[clean_name(c) for c in df.columns])
        df = df.select(F.col("_metadata.file_name").alias("file_name"),
                       F.col("_metadata.file_path").alias("file_path"),
                       F.col("_metadata.file_block_start").alias("file_block_start"),
                       F.monotonically_increasing_id().alias("seq"), "*")
        parts.append(df)
    out = stack_by_name(parts)
    if file_col and file_col != "file_name":
        out = out.withColumnRenamed("file_name", file_col)
    return out


def with_file_name(df: DataFrame, name: str = "File") -> DataFrame:
    """S3: source file name as the first column (for tables read from files)."""
    return df.select(F.col("_metadata.file_name").alias(name), "*")
