"""Connected components of a link table.

Each partition first reduces its links to a forest of stars by union-find in memory
of its own size. Then large-star and small-star steps alternate: every step is a
minimum per node (reduced before its shuffle) and a join with the links; the tables of
minima are written first, so a small one is broadcast by its measured size and AQE can
split the links of a node with many of them. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm.shared import written


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one partition as (node, smallest node of its part)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    found = [(x, r) for x in parent if (r := root(x)) != x]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link; null or self links are ignored.

    With ``rounds`` it stops after so many rounds: nodes of one component are connected then, but a connected part may
    still have several. That is enough to spare work.
    """
    now = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_forests, "u bigint, v bigint"), "links")
    state, done = None, 0
    while done != rounds:
        now = written(_small_star(_large_star(now)), "links")
        done += 1
        if rounds is None:
            found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(found) == state:
                break
            state = tuple(found)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return written(ends.groupBy("node").agg(F.min("component").alias("component")), "components")
