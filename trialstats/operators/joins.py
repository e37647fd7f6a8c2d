"""Joins (J1-J7).

dplyr joins match NA with NA (rule 5). Instead of one ``<=>`` per key (which the
planner turns into coalesce/isnull hash keys and a fresh shuffle), the keys are
packed into one struct column: struct equality treats null fields as equal, it is
a plain equi-join, and a side that is already hash-partitioned on the struct is
not shuffled again.

The right sides are per-group tables whose size grows with the number of groups. The
choice of the join is left to the planner and AQE, but in ``join_group_stats``, which
measures its right side: the planner's guess does not count its repeats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_K = "_jn_key"
BROADCAST_BYTES = 1 << 20  # most text of statistics that are broadcast: about 10,000 groups


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the key columns appear once (left's)."""
    keys = list(keys)
    l = left.withColumn(_K, F.struct(*keys))
    r = right.withColumn(_K, F.struct(*keys)).drop(*keys)
    return l.join(r, _K, how).drop(_K)


def left_join_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Natural left join on all shared column names, null-safe (dplyr default ``by``)."""
    keys = [c for c in left.columns if c in right.columns]
    return null_safe_join(left, right, keys, "left")


def left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join on named keys (per-participant attributes)."""
    return null_safe_join(left, right, [on] if isinstance(on, str) else list(on), "left")


def with_group_mean(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """J4 + A4: add ``{out: col}`` group means to each row; R's ``mean`` without ``na.rm``
    is NA when any value of the group is NA (rule 1)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({
        out: F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), F.avg(c).over(w))
        for out, c in cols.items()})


def complete_left(df: DataFrame, keys: Sequence[str], stats: DataFrame,
                  fill: Mapping[str, Any] | None = None) -> DataFrame:
    """Frame of the distinct ``keys`` of ``df`` left-joined with ``stats``; missing → ``fill``."""
    frame = df.select(*keys).distinct()
    out = null_safe_join(frame, stats, keys, "left")
    return out.fillna(dict(fill)) if fill else out


def join_group_stats(rows: DataFrame, stats: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Statistics of each group back on its rows, whatever part of the rows one group holds and however many groups there are.

    ``stats`` (one row per group) is read twice, so it should be a written table. The planner would guess its size from
    compressed files, without the repeats, and AQE keeps a broadcast chosen by that guess. So its text is measured: small
    statistics are broadcast once each and the rows stay; others never go to the driver. A hot key is not split where the
    partitioning by the key serves what follows too, so these are repeated for each salt and the rows of a group are dealt over the
    salts by their content. Every row has its group's statistics; the join is an outer one so that the rows are never the side that is broadcast.
    """
    text = stats.agg(F.sum(F.octet_length(F.struct("*").cast("string")))).first()[0]
    if (text or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(stats), key, "left")
    salted = stats.withColumn("_jn_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(salts)).cast("int")
    return rows.withColumn("_jn_salt", own).join(salted, [key, "_jn_salt"], "left").drop("_jn_salt")


def assert_same_count(a: DataFrame, b: DataFrame) -> None:
    """Q1: row parity of two tables about to be combined (an action; for tests and checks)."""
    na, nb = a.count(), b.count()
    if na != nb:
        raise AssertionError(f"row counts differ: {na} != {nb}")
