"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups.

Equal texts form one group, which is never split. Groups are ordered by a 64-bit
hash of their text. The smallest capacity C is sought for which a greedy pass
(cut before the first group that would overflow C) needs at most ``shards``
shards; the rows are cut there.

Plan. The ordered group sizes are never brought to the driver. It holds sums of
key ranges, refined level by level: one Spark aggregate per level splits only
those ranges in which a cut can still lie, each into at most 2^12 parts. At every
level a binary search over C runs twice on the known ranges, once with every open
range taken as one atomic group (that C is feasible for certain) and once with
open ranges taken as divisible (no smaller C is feasible); the k-th cut lies
between the k-th cuts of the two. This ends when no open range is left, mostly
after two or three levels: about (number of shards)^2 / 2 ranges are open at
most, whatever the number of groups. Two texts of one hash count as one group.

Slots number the rows of a shard without a gap. They are dealt over bins by a
hash of the document, so a group with a third of all rows is numbered by many
tasks; only the (shard, bin) counts meet in one place.

A group above the even share of the bytes gets a shard of its own (there are fewer
than ``shards`` such groups); the others are partitioned over the shards that are
left, so one hot text does not leave shards empty.

Edge cases. A null text has size 1 (no bytes, plus one) and forms one group with
other null texts, apart from empty texts. Null ids and repeated rows are rows
like any other and get a slot each. With fewer groups than shards the last shards stay empty. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm.shared import written

LEVEL_BITS = 12
KEY_BITS = 64


@dataclass(frozen=True)
class Range:
    """Groups with keys in [low, low + 2^bits): their bytes, and whether they may hold more than one group."""

    low: int
    bits: int
    size: int
    open: bool


def greedy_cuts(sums: list[int], capacity: int, divisible: list[bool] | None = None) -> list[tuple[int, int]]:
    """Cuts of a greedy pass as (index of the item at the cut, bytes of it before the cut).

    ``sums`` are running sums with a leading 0. An item that fits in no shard is an error of the caller.
    """
    cuts, at = [], 0
    while at + capacity < sums[-1]:
        i = bisect_right(sums, at + capacity) - 1
        if divisible is not None and divisible[i]:
            cuts.append((i, at + capacity - sums[i]))
            at += capacity
        else:
            cuts.append((i, 0))
            if sums[i] <= at:
                raise ValueError("an item is larger than the capacity")
            at = sums[i]
    return cuts


def smallest_capacity(sizes: list[int], shards: int, divisible: list[bool] | None = None) -> int:
    """Binary search for the smallest capacity with at most ``shards`` greedy shards."""
    if not sizes:
        return 0
    sums = list(accumulate(sizes, initial=0))
    whole = [s for i, s in enumerate(sizes) if divisible is None or not divisible[i]]
    low, high = max([-(-sums[-1] // shards), 1, *whole]), max(sums[-1], 1)
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sums, mid, divisible)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def _ranges(groups: DataFrame, parents: list[tuple[int, int]]) -> list[Range]:
    """The non-empty parts of the parent ranges (low key, bits), in key order."""
    bits = max(0, parents[0][1] - LEVEL_BITS)
    key = F.col("key")  # signed; the order is that of the signed key
    part = F.shiftright(key, bits)
    if len(parents) > 1 or parents[0][1] < KEY_BITS:
        wanted = [low >> parents[0][1] for low, _ in parents]
        groups = groups.where(F.shiftright(key, parents[0][1]).isin(wanted))
    rows = groups.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    return [Range(r["a"] if r["a"] == r["b"] else r["part"] << bits, bits, r["size"], r["a"] != r["b"]) for r in sorted(rows, key=lambda r: r["part"])]


def _earliest(sums: list[int], capacity: int, cuts: int) -> list[int]:
    """Index of the item that holds the k-th cut or lies before it, at this capacity and however an item may be split."""
    out, at = [], 0
    while at + capacity < sums[-1] and len(out) < cuts:
        i = bisect_right(sums, at + capacity) - 1
        at = max(at, sums[i])
        out.append(bisect_right(sums, at) - 1)
    return out


def minimax_cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First key of each shard but the first, and the capacity. ``groups``: key (bigint), size (bigint), one row per group."""
    ranges = _ranges(groups, [(-(1 << (KEY_BITS - 1)), KEY_BITS)])
    while True:
        sizes, divisible = [r.size for r in ranges], [r.open for r in ranges]
        sums = list(accumulate(sizes, initial=0))
        sure = smallest_capacity(sizes, shards)
        least = smallest_capacity(sizes, shards, divisible)
        late = greedy_cuts(sums, sure, divisible)
        wanted = {i for i, r in enumerate(ranges) if r.open and r.size > least}  # it may hold one group that decides
        for k, i in enumerate(_earliest(sums, least, shards - 1)):
            j = late[k][0] if k < len(late) else len(ranges) - 1
            wanted.update(x for x in range(i, j + 1) if x < len(ranges) and ranges[x].open)
        if not wanted:
            return [ranges[i].low for i, _ in greedy_cuts(sums, sure)], sure
        refined: dict[int, list[Range]] = {i: [] for i in wanted}
        for bits in {ranges[i].bits for i in wanted}:
            of = {ranges[i].low >> bits: i for i in sorted(wanted) if ranges[i].bits == bits}
            for part in _ranges(groups, [(low << bits, bits) for low in of]):
                refined[of[part.low >> bits]].append(part)
        ranges = [p for i, r in enumerate(ranges) for p in refined.get(i, [r])]


def oversize_groups(groups: DataFrame, shards: int, total: int) -> list[tuple[int, int]]:
    """(key, size) of the groups above the even share of what remains without the larger ones; fewer than ``shards``."""
    found: list[tuple[int, int]] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        left = shards - len(found)
        if left < 2 or r["size"] * left <= total:
            break
        found.append((r["key"], r["size"]))
        total -= r["size"]
    return found


def shard_documents(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    rows_per_bin: int = 100_000) -> DataFrame:
    """Every row of ``docs`` with its size, shard and slot (see the module's notes)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)).alias("key"))
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "shard-groups")
    total, n = groups.agg(F.sum("size"), F.sum("rows")).first()
    alone = oversize_groups(groups, shards, total or 0)
    rest = groups.where(~F.col("key").isin([k for k, _ in alone])) if alone else groups
    cuts, _ = minimax_cut_keys(rest, shards - len(alone))
    shard = F.lit(len(alone))
    for k, low in enumerate(cuts, len(alone) + 1):
        shard = F.when(F.col("key") >= low, k).otherwise(shard)
    for k, (key, _) in enumerate(alone):
        shard = F.when(F.col("key") == key, k).otherwise(shard)
    bins = max(1, -(-(n or 0) // (shards * rows_per_bin)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(bins)).cast("int"))
    return with_slots(placed, "shard", "bin", ["key", "doc_id", "size", "text_crc32"]).drop("bin", "key")


def with_slots(placed: DataFrame, shard: str, bin_col: str, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0: row numbers within (shard, bin), after the rows of the earlier bins.

    The counts table has one row per (shard, bin), as many as there are tasks; it is small beside the rows.
    """
    counts = placed.groupBy(shard, bin_col).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy(shard, bin_col).orderBy(*order)).cast("long") - 1
    return (placed.withColumn("within", number).join(starts, [shard, bin_col])
            .withColumn("slot", F.col("within") + F.col("before")).drop("within", "before"))
