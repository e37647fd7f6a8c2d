"""Ordered scans inside groups: lag, row number, running sum, back-fill.

The reference relies on the row order of its files. Here every scan takes an
explicit partition key and order key, and runs in one shape for groups of any size:

1. ``ranged`` deals the table to ranges of (keys, order) with the engine's range exchange
   and writes it once, with the range as a column, as a table bucketed by the range. A
   range's bounds come from the engine's sample of the full key, so bursts, ties in the
   leading order column and hot groups are cut like any other rows, and the number of
   ranges follows the bytes of the input.
2. Rows are windowed per (range, group). The table is bucketed by the range, so the
   windows need no exchange, and a second scan along the same order needs none either.
3. Each (range, group) is summarised to one row (count, last value, sum, first
   non-null), and the few groups that lie in several ranges are scanned over these rows.
4. What they carry goes back as one row for each range (two cut groups in it at most),
   broadcast to the ranges: the rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.session import bucketed, input_bytes

RANGES_CONF = "spark.trialstats.scanRanges"      # number of ranges, in place of that from the input's size
RANGE_BYTES_CONF = "spark.trialstats.rangeBytes"  # input bytes of a range
DEFAULT_RANGE_BYTES = 64 << 20

_SEG = "_ts_seg"
_RN = "_ts_rn"
_CARRY = "_ts_carry"


def range_count(df: DataFrame) -> int:
    """Ranges for a table: one for each ``rangeBytes`` of its input, and as many as there are cores at least."""
    spark = df.sparkSession
    given = spark.conf.get(RANGES_CONF, None)
    if given:
        return max(1, int(given))
    size = int(spark.conf.get(RANGE_BYTES_CONF, str(DEFAULT_RANGE_BYTES)))
    return max(spark.sparkContext.defaultParallelism, -(-input_bytes(df) // size))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "scan_segment") -> DataFrame:
    """The table in ranges of (keys, order), written once; ``name`` is the range, which never falls along that order.

    ``order`` names ascending columns; with the keys it should tell rows apart, since equal
    rows of the full key cannot be cut.
    """
    n = range_count(df)
    cut = df.repartitionByRange(n, *keys, *[c for c in order if c not in keys]).withColumn(name, F.spark_partition_id())
    return bucketed(cut, n, name, "ranges")


def _name(column: str) -> str:
    """A column name in SQL text."""
    return "`" + column.replace("`", "``") + "`"


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, str] | None = None,
    row_number: str | None = None,
    running_sum: Mapping[str, str] | None = None,
    fill_up: Mapping[str, str] | None = None,
    segment: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add scan columns computed in ``order`` within each group of ``keys``.

    ``lag``         — ``{out: col}``: value of ``col`` on the previous row (W1).
    ``row_number``  — name of a 1-based bigint position column (W3, D11).
    ``running_sum`` — ``{out: col}``: sum of ``col`` from the first row to this one (W2);
                      nulls are skipped, as Spark's ``sum`` does.
    ``fill_up``     — ``{out: col}``: this row's ``col``, else the next non-null value
                      below it in the group (tidyr ``fill(.direction='up')``, N5/N6).
    ``segment``     — a column that never falls along ``order`` inside a group, where the
                      caller has one (best that of ``ranged``); by default the table is ranged.
    ``descending``  — number the rows from the last one (row numbers only).
    """
    lag, running_sum, fill_up = dict(lag or {}), dict(running_sum or {}), dict(fill_up or {})
    if descending and (lag or running_sum or fill_up):
        # the segment summaries pick the last / first row with max_by / min_by on the ascending struct
        raise ValueError("descending supports row_number only; scan in ascending order instead")
    columns, keys = df.columns, list(keys)
    if segment is None:
        df, segment = ranged(df, keys, order, _SEG), F.col(_SEG)
    base = df.withColumn(_SEG, segment)
    # the columns are built as SQL text: a few calls to the JVM in place of hundreds
    group = ", ".join([*map(_name, keys), "0"])  # never empty
    by = ", ".join([_SEG, *map(_name, keys)])
    along = ", ".join(_name(c) + (" DESC" if descending else "") for c in order)
    place = f"struct({', '.join(map(_name, order))})"
    lags, sums, fills = (list(enumerate(m.items())) for m in (lag, running_sum, fill_up))

    inside = f"OVER (PARTITION BY {by} ORDER BY {along}"
    inner = [f"row_number() {inside}) AS {_RN}"]
    inner += [f"lag({_name(c)}) {inside}) AS _ts_lag{i}" for i, (_, c) in lags]
    inner += [f"sum({_name(c)}) {inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ts_sum{i}" for i, (_, c) in sums]
    inner += [f"first({_name(c)}, true) {inside} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _ts_fill{i}" for i, (_, c) in fills]
    rows = base.selectExpr("*", *inner)

    # one row per (segment, group), from the columns that the scan needs
    aggs = ["count(1) AS _ts_n"]
    aggs += [f"max_by({_name(c)}, {place}) AS _ts_last{i}" for i, (_, c) in lags]
    aggs += [f"sum({_name(c)}) AS _ts_total{i}" for i, (_, c) in sums]
    aggs += [f"min_by({_name(c)}, CASE WHEN {_name(c)} IS NOT NULL THEN {place} END) AS _ts_first{i}" for i, (_, c) in fills]
    summary = base.groupBy(_SEG, *keys).agg(*map(F.expr, aggs))

    # groups in several segments: their rows in segment order
    across = f"OVER (PARTITION BY {group}"
    walk = f"{across} ORDER BY {_SEG}{' DESC' if descending else ''}"
    before = f"{walk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = [f"coalesce(sum(_ts_n) {before}, 0) AS off"]
    carry += [f"lag(_ts_last{i}) {walk}) AS prev{i}" for i, _ in lags]
    carry += [f"sum(_ts_total{i}) {before} AS sum{i}" for i, _ in sums]
    carry += [f"first(_ts_first{i}, true) {walk} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next{i}" for i, _ in fills]
    several = summary.selectExpr("*", f"count(1) {across}) AS _ts_in").where("_ts_in > 1")
    several = several.selectExpr(_SEG, f"struct({group}) AS _ts_group",
                                 *[c[:c.rindex(" AS ")] + " AS _ts_c_" + c[c.rindex(" AS ") + 4:] for c in carry])
    parts = ", ".join(f"_ts_c_{n} AS {n}" for n in (c[c.rindex(" AS ") + 4:] for c in carry))
    by_segment = several.groupBy(_SEG).agg(F.expr(f"collect_list(struct(_ts_group AS here, {parts})) AS {_CARRY}"))

    # one row for each range, broadcast: else, with fewer ranges than shuffle partitions, the rows are dealt anew by a key of few values
    joined = rows.join(F.broadcast(by_segment), _SEG, "left").selectExpr("*", f"get(filter({_CARRY}, x -> x.here <=> struct({group})), 0) AS _ts_from")
    final = {out: f"CASE WHEN {_RN} = 1 THEN _ts_from.prev{i} ELSE _ts_lag{i} END" for i, (out, _) in lags}
    if row_number:
        final[row_number] = f"cast({_RN} + coalesce(_ts_from.off, 0) AS bigint)"
    final |= {out: f"CASE WHEN _ts_sum{i} IS NOT NULL OR _ts_from.sum{i} IS NOT NULL THEN coalesce(_ts_sum{i}, 0) + coalesce(_ts_from.sum{i}, 0) END"
              for i, (out, _) in sums}
    final |= {out: f"coalesce(_ts_fill{i}, _ts_from.next{i})" for i, (out, _) in fills}
    keep = [_name(c) for c in columns if c not in final]
    return joined.selectExpr(*keep, *[f"{e} AS {_name(n)}" for n, e in final.items()])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in ``order`` (``row_number() == 1``).

    Deterministic, unlike ``dropDuplicates``. Implemented as an aggregate
    (``min_by`` of the whole row) rather than a window, so a hot group is
    reduced map-side instead of being sorted in one task.
    """
    others = [c for c in df.columns if c not in keys]
    ord_struct = F.struct(*_cols(order))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), ord_struct).alias("_ts_row"))
    return picked.select(*keys, *[F.col(f"_ts_row.{c}").alias(c) for c in others])


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], switch_col: str, task_col: str, out: str = "n",
                segment: Column | None = None) -> DataFrame:
    """Gaps and islands. Running count of switches numbers the runs; rows per run are counted."""
    scanned = ordered_scan(df, keys, order, running_sum={"sumSwitch": switch_col}, segment=segment)
    return scanned.groupBy(*keys, "sumSwitch", task_col).agg(F.count(F.lit(1)).cast("long").alias(out))
