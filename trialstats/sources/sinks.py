"""Result sinks (S4): the reference saves each result as a picture; the table behind it is saved here."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_summary(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Write a result table (Parquet by default; ``fmt='csv'`` writes a header row).

    With ``partition_by`` and ``mode='overwrite'`` only the partitions that ``df`` holds are replaced, so a
    rerun for some blocks or days gives the same table and leaves the others as they are.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Write a result as a table bucketed and sorted by ``by`` (the participant); joins and aggregates by these
    columns of tables with as many buckets need no exchange. A rerun replaces the table."""
    by = list(by)
    dealt = df.repartition(buckets, *by)  # one file for each bucket
    dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_with_parity(tables: Sequence[DataFrame], combine: Callable[..., DataFrame], path: str) -> int:
    """Q1: write ``combine(*tables)`` only if all tables have the same number of rows; returns that number.

    The rows of each table are counted by observed metrics inside the one job that writes; the result
    is written beside ``path`` and put in its place after the check. On unlike counts nothing is left and the call fails.
    """
    seen = [Observation(f"rows-{i}-{uuid.uuid4().hex}") for i in range(len(tables))]
    out = combine(*[t.observe(o, F.count(F.lit(1)).alias("n")) for t, o in zip(tables, seen)])
    spark = out.sparkSession
    jvm = spark.sparkContext._jvm
    staged, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (os.path.join(os.path.dirname(path.rstrip("/")), f"_staged-{uuid.uuid4().hex}"), path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out.write.parquet(staged.toString())
    counts = [o.get["n"] for o in seen]
    if len(set(counts)) > 1:
        fs.delete(staged, True)
        raise AssertionError(f"row counts differ: {counts}")
    fs.delete(target, True)
    fs.rename(staged, target)
    return counts[0]
