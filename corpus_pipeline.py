"""From documents to packed training sequences.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); each stage gets the
documents that the stage before it kept. All but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it
again, so a stage starts from files and not from the lineage of those before it.

The quality stage scores with trees, which SQL cannot express, so there is no
``ORACLE_SQL``; the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialstats.llm.decontaminate import without_leaks
from trialstats.llm.jaccard import one_of_each_group
from trialstats.llm.packing import pack
from trialstats.llm.quality import keep_good, train_on_labels
from trialstats.llm.secrets import redacted
from trialstats.llm.shared import written
from trialstats.sources.tables import table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; the trees learn from the labels of these documents."""
    return keep_good(docs, train_on_labels(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 75 % of shared shingles."""
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a marker and ``n_chars`` set anew."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
