"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Every trial query starts from the ``trials`` CTE below, which is the SQL form
of ``trials_from_events`` (FIXTURES.md §3). Rules kept in step with the Spark
side: ``bround`` ↔ ``round_even``; ``try_divide(a, b)`` ↔ ``a / nullif(b, 0)``
on doubles; counts and integer sums cast to BIGINT; DuckDB ``mad`` is unscaled.
"""

from __future__ import annotations

from trialstats.functions.distributions import t975_sql_duckdb

EVENTS_BASE = """
ev AS (
  SELECT ts, event_id, CAST(user_id AS BIGINT) AS id,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(floor((dayofmonth(ts) - 1) / 8) + 1 AS INTEGER) AS blockNr,
         CASE WHEN event_type IN ('click', 'view') THEN 'loc'
              WHEN event_type IN ('purchase', 'signup') THEN 'shape'
              WHEN event_type = 'error' THEN 'shapeloc' END AS task_perf,
         value / 100 AS rt
  FROM events),
ev2 AS (
  SELECT *, CAST(CASE WHEN ((id % 4) + 4) % 4 = 0 THEN 4 ELSE ((id % 4) + 4) % 4 END AS INTEGER) AS countBal,
         ((k % 3) + 3) % 3 AS km3
  FROM ev),
ev3 AS (
  SELECT *,
    CASE WHEN countBal IN (1, 3) THEN 'mix-free' WHEN countBal IN (2, 4) THEN 'free-mix' END AS cBal,
    CASE WHEN (blockNr <= 2) = (countBal IN (1, 3)) THEN 'mixed' ELSE 'freeOnly' END AS block,
    CASE km3 WHEN 0 THEN 'XXXX' WHEN 1 THEN 'JAKI' WHEN 2 THEN 'GDZIE' END AS cue,
    CASE WHEN task_perf = 'shapeloc' THEN '' WHEN k = 42 THEN 'xm'
         WHEN task_perf = 'loc' THEN 'x' ELSE 'm' END AS resp,
    CAST(CASE WHEN k >= 98 THEN 999 WHEN ((k % 10) + 10) % 10 < 8 THEN 1 ELSE 0 END AS INTEGER) AS corr
  FROM ev2),
ev4 AS (
  SELECT *,
    CASE WHEN block = 'freeOnly' OR km3 = 0 THEN 'free' ELSE 'forced' END AS trial_type,
    CASE cue WHEN 'JAKI' THEN 'shape' WHEN 'GDZIE' THEN 'loc' WHEN 'XXXX' THEN 'any'
             ELSE 'unknownTask' END AS task_cued
  FROM ev3),
coded AS (
  SELECT *,
    row_number() OVER w AS trialNr,
    lag(task_perf) OVER w AS prev_task
  FROM ev4
  WINDOW w AS (PARTITION BY id, blockNr ORDER BY ts, event_id)),
coded2 AS (
  SELECT *,
    CASE WHEN task_perf = 'shape' AND prev_task = 'shape' THEN 'stay_shape'
         WHEN task_perf = 'loc' AND prev_task = 'loc' THEN 'stay_loc'
         WHEN task_perf = 'shape' AND prev_task = 'loc' THEN 'switch_shape'
         WHEN task_perf = 'loc' AND prev_task = 'shape' THEN 'switch_loc' END AS switch_type
  FROM coded),
coded3 AS (
  SELECT *,
    CASE WHEN switch_type IN ('stay_shape', 'stay_loc') THEN CAST(0 AS DOUBLE)
         WHEN switch_type IN ('switch_shape', 'switch_loc') THEN CAST(1 AS DOUBLE) END AS switch
  FROM coded2),
trials AS (
  SELECT id, countBal, cBal, block, blockNr, trialNr, trial_type, task_cued, task_perf, resp, rt,
         corr, switch_type, switch
  FROM coded3
  WHERE corr < 999 AND length(resp) <= 1)"""


def with_trials(*ctes: str) -> str:
    """``WITH <events → trials>, <ctes...>`` — prefix for every trial query."""
    parts = [EVENTS_BASE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


# summary statistics over a long (group..., variable, value) relation ------------------------

def summary_sql(source: str, groups: list[str], kind: str = "common", value: str = "value",
                variable: str = "variable") -> str:
    """SQL of ``summary_stats``: per group × variable over non-null values, rounded to 3."""
    g = ", ".join(groups + [variable])
    t = t975_sql_duckdb("(n - 1)")
    r = lambda e: f"round_even({e}, 3)"
    src = f"(SELECT {g}, CAST({value} AS DOUBLE) AS v_ FROM {source}) src_"
    base = f"""
SELECT {g}, CAST(count(v_) AS BIGINT) AS n, min(v_) AS mn, max(v_) AS mx,
       quantile_cont(v_, 0.5) AS med, quantile_cont(v_, 0.25) AS q1,
       quantile_cont(v_, 0.75) AS q3, 1.4826 * mad(v_) AS mad_, avg(v_) AS mean_,
       stddev_samp(v_) AS sd_
FROM {src} WHERE v_ IS NOT NULL GROUP BY {g}"""
    cols = [f"{r('mn')} AS min", f"{r('mx')} AS max", f"{r('med')} AS median"]
    if kind == "full":
        cols += [f"{r('q1')} AS q1", f"{r('q3')} AS q3"]
    cols += [f"{r('q3 - q1')} AS iqr"]
    if kind == "full":
        cols += [f"{r('mad_')} AS mad"]
    cols += [f"{r('mean_')} AS mean", f"{r('sd_')} AS sd", f"{r('sd_ / sqrt(n)')} AS se",
             f"{r(f'{t} * sd_ / sqrt(n)')} AS ci"]
    return f"SELECT {g}, n, {', '.join(cols)} FROM ({base}) s"
