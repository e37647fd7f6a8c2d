"""Session helpers: a local session for tests / bench, and lineage cuts.

On a cluster the session is created by the platform; the helpers here only
read its settings. ``spark.checkpoint.dir`` must name a folder every executor
can reach (HDFS / object store); it is set here only when it is unset, which
is the case in local tests.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trialstats") -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on, ANSI on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; only a local session without one gets a scratch folder."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="trialstats-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df: DataFrame, name: str | None = None, key: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    Unlike ``localCheckpoint`` the files survive the loss of an executor; unlike
    ``cache`` the plan below is not recomputed after such a loss. With ``key`` the
    table is written once per checkpoint folder and read back on later calls (for
    deterministic derived inputs such as a fixture built from a given table).
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if key is not None:
        path = os.path.join(base, f"{name or 'table'}-{hashlib.sha1(key.encode()).hexdigest()[:16]}")
        if not _exists(spark, os.path.join(path, "_SUCCESS")):
            df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    path = os.path.join(base, f"{name or 'table'}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, buckets: int, by: str, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder as a table bucketed by ``by``: later windows and joins on
    ``by`` (and more columns) need no exchange of it."""
    spark = df.sparkSession
    table = f"trialstats_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", os.path.join(ensure_checkpoint_dir(spark), table)).saveAsTable(table)
    return spark.table(table)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``, as the planner knows them (no job); sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session (works on HDFS / object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
