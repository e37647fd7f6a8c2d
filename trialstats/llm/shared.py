"""Tables that cut lineage, and values sent to the executors."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from trialstats.session import materialize


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``; survives the loss of executors."""
    return materialize(df, f"llm-{name}")


def shipped(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast of a value of this package's classes; their code goes along, as it does with functions."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(value: Broadcast, make: Callable[[Any], Any] | None = None) -> Any:
    """The value of ``shipped``, inside a task; with ``make``, what that builds of it.

    What is built stays with the broadcast in the Python worker, so that its later tasks find it, until the broadcast
    is destroyed. It must not be changed.
    """
    if make is None:
        return pickle.loads(value.value)
    if not hasattr(value, "built"):
        value.built = make(pickle.loads(value.value))
    return value.built
