"""Query catalogue: every operator of SURVEY §2 as (Spark query, DuckDB oracle SQL).

``queries()`` maps a name to ``fn(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
maps the same name to SQL over the driver tables (registered as views). Column
names are aliased identically on both sides, and every query has a SQL twin
(tests check that the two results are equal, bit for bit at sf 0.01).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialstats.plans import metrics as M
from trialstats.plans.oracle_sql import summary_sql, with_trials
from trialstats.plans.trials import trials_from_events
from trialstats.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials_from_events(table(spark, sf_dir, "events"))


def _trial_query(name: str, metric: Callable[[DataFrame], DataFrame], sql: str | None, scans: bool = False) -> None:
    """``scans``: the metric scans along the trial numbers and takes the segment of the coding."""
    register(name, sql)(lambda spark, sf_dir: metric(trials_from_events(table(spark, sf_dir, "events"), with_segment=scans)))


# ================================================================ SQL building blocks

S1 = """s1 AS (
  SELECT id, block, sum(switch) AS switch_sum, CAST(count(*) AS BIGINT) AS n,
         round_even(sum(switch) / count(*), 3) AS vsr
  FROM trials WHERE switch IS NOT NULL AND trial_type = 'free' GROUP BY id, block)"""

# literal nested joins of the reference (J3), not the one-aggregate form used on the Spark side
S2 = S1 + """,
cd AS (SELECT id, block, count(*) AS switch_diff FROM trials
       WHERE trial_type = 'free' AND switch_type = 'switch_shape' GROUP BY id, block),
ce AS (SELECT id, block, count(*) AS switch_easy FROM trials
       WHERE trial_type = 'free' AND switch_type = 'switch_loc' GROUP BY id, block),
cde AS (SELECT cd.id, cd.block, cd.switch_diff, ce.switch_easy FROM cd LEFT JOIN ce
        ON cd.id IS NOT DISTINCT FROM ce.id AND cd.block IS NOT DISTINCT FROM ce.block),
s2 AS (
  SELECT s1.id, s1.block, s1.switch_sum,
         CAST(coalesce(cde.switch_easy, 0) AS BIGINT) AS switch_easy,
         CAST(coalesce(cde.switch_diff, 0) AS BIGINT) AS switch_diff, s1.n, s1.vsr,
         coalesce(CAST(cde.switch_easy AS DOUBLE) / s1.n, 0) AS vsr_easy,
         coalesce(CAST(cde.switch_diff AS DOUBLE) / s1.n, 0) AS vsr_diff
  FROM s1 LEFT JOIN cde ON s1.id IS NOT DISTINCT FROM cde.id AND s1.block IS NOT DISTINCT FROM cde.block)"""

S3 = S2 + """,
s3 AS (
  SELECT s2.*,
    round_even(CASE WHEN count(vsr) OVER (PARTITION BY id) = count(*) OVER (PARTITION BY id)
                    THEN avg(vsr) OVER (PARTITION BY id) END, 6) AS vsr_avg,
    round_even(CASE WHEN count(vsr_easy) OVER (PARTITION BY id) = count(*) OVER (PARTITION BY id)
                    THEN avg(vsr_easy) OVER (PARTITION BY id) END, 6) AS vsr_easy_avg,
    round_even(CASE WHEN count(vsr_diff) OVER (PARTITION BY id) = count(*) OVER (PARTITION BY id)
                    THEN avg(vsr_diff) OVER (PARTITION BY id) END, 6) AS vsr_diff_avg
  FROM s2)"""

VSR_LONG = """vl AS (
  SELECT id, block, 'easy' AS difficulty, 'vsr_difficulty' AS variable, vsr_easy AS value FROM s2
  UNION ALL
  SELECT id, block, 'diff', 'vsr_difficulty', vsr_diff FROM s2)"""

CBAL = """cb AS (SELECT id, arg_min(cBal, (blockNr, trialNr)) AS cBal FROM trials GROUP BY id)"""

# free trials with a known switch status, running sum of switches, runs
X2 = """p8 AS (
  SELECT id, block, blockNr, trialNr, task_perf,
         sum(switch) OVER (PARTITION BY id, block, blockNr ORDER BY trialNr
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sumSwitch
  FROM trials WHERE switch IS NOT NULL AND trial_type = 'free'),
x2 AS (
  SELECT id, block, blockNr, sumSwitch, task_perf, CAST(count(*) AS BIGINT) AS n
  FROM p8 GROUP BY id, block, blockNr, sumSwitch, task_perf)"""


def _acc_sql(where: str, keys: str) -> str:
    return f"""acc AS (
  SELECT {keys}, CAST(coalesce(sum(corr), 0) AS BIGINT) AS sumCorr, CAST(count(*) AS BIGINT) AS n,
         CAST(coalesce(sum(corr), 0) AS DOUBLE) / count(*) AS acc
  FROM trials WHERE {where} GROUP BY {keys})"""


def _long(source: str, ids: list[str], cols: list[str], name_col: str = "variable", value_col: str = "value",
          names: list[str] | None = None) -> str:
    idl = ", ".join(ids)
    names = names or cols
    parts = [f"SELECT {idl}{', ' if ids else ''}'{n}' AS {name_col}, {c} AS {value_col} FROM {source}"
             for c, n in zip(cols, names)]
    return "\nUNION ALL\n".join(parts)


ORDER_CASE = ("CAST(CASE switch_type WHEN 'stay_loc' THEN 1 WHEN 'switch_loc' THEN 2 "
              "WHEN 'stay_shape' THEN 3 WHEN 'switch_shape' THEN 4 ELSE 0 END AS INTEGER) AS switch_type_order")


# ================================================================ E1-E9: VSR

_trial_query("vsr", M.vsr, with_trials(S1) + "SELECT * FROM s1")
_trial_query("vsr_decomposed", M.vsr_decomposed, with_trials(S2) + "SELECT * FROM s2")
_trial_query("vsr_participant_mean", M.vsr_participant_mean, with_trials(S3) + "SELECT * FROM s3")
_trial_query("vsr_summary_difficulty", M.vsr_summary_difficulty,
             with_trials(S2, VSR_LONG) + summary_sql("vl", ["difficulty"], "full"))
_trial_query("vsr_summary_block_difficulty", lambda t: M.vsr_summary_difficulty(t, ("block", "difficulty")),
             with_trials(S2, VSR_LONG) + summary_sql("vl", ["block", "difficulty"], "full"))
_trial_query("vsr_summary_id_block_difficulty",
             lambda t: M.vsr_summary_difficulty(t, ("id", "block", "difficulty")),
             with_trials(S2, VSR_LONG) + summary_sql("vl", ["id", "block", "difficulty"], "full"))
_trial_query("vsr_summary_block", M.vsr_summary_block,
             with_trials(S1, "l AS (SELECT block, 'vsr' AS variable, vsr AS value FROM s1)")
             + summary_sql("l", ["block"]))
_trial_query("switch_difference", M.switch_difference,
             with_trials(S2, "l AS (SELECT block, 'switch_difference' AS variable, "
                             "switch_easy - switch_diff AS value FROM s2)") + summary_sql("l", ["block"]))

_SHARE = S2 + """,
sh AS (SELECT id, block, vsr_easy / nullif(vsr_diff + vsr_easy, 0) AS vsr_easy_prop,
              vsr_diff / nullif(vsr_diff + vsr_easy, 0) AS vsr_diff_prop FROM s2),
l AS (""" + _long("sh", ["id", "block"], ["vsr_easy_prop", "vsr_diff_prop"], "vsr_type", "vsr_prop") + """),
ll AS (SELECT id, block, vsr_type, 'vsr_prop' AS variable, vsr_prop FROM l)"""
_trial_query("vsr_component_share", M.vsr_component_share,
             with_trials(_SHARE) + summary_sql("ll", ["block", "vsr_type"], value="vsr_prop"))
_trial_query("vsr_component_share_id", lambda t: M.vsr_component_share(t, ("id", "block", "vsr_type")),
             with_trials(_SHARE) + summary_sql("ll", ["id", "block", "vsr_type"], value="vsr_prop"))

_trial_query("vsr_mixed_long", M.vsr_mixed_long, with_trials(S3) + """
SELECT id, block, switch_sum, switch_easy, switch_diff, n, vsr, vsr_avg, vsr_easy_avg, vsr_diff_avg,
       d.difficulty, CASE d.difficulty WHEN 'easy' THEN vsr_easy ELSE vsr_diff END AS vsr_difficulty,
       CASE d.difficulty WHEN 'easy' THEN 'Easy' WHEN 'diff' THEN 'Difficult' END AS difficulty_label
FROM s3, (VALUES ('easy'), ('diff')) d(difficulty) WHERE block = 'mixed'""")

_trial_query("vsr_by_counterbalance", M.vsr_by_counterbalance,
             with_trials(S1, CBAL, "l AS (SELECT cb.cBal, s1.block, 'vsr' AS variable, s1.vsr AS value "
                                   "FROM s1 LEFT JOIN cb ON s1.id = cb.id)") + summary_sql("l", ["cBal", "block"]))

# ================================================================ E10-E13: switch / stay shares

_trial_query("switch_types_per_id", M.switch_types_per_id, with_trials("""
c AS (SELECT id, switch_type, count(*) AS n FROM trials WHERE switch IS NOT NULL GROUP BY id, switch_type),
ids AS (SELECT DISTINCT id FROM c)""") + """
SELECT ids.id, t.switch_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM ids CROSS JOIN (VALUES ('stay_loc'), ('stay_shape'), ('switch_loc'), ('switch_shape')) t(switch_type)
LEFT JOIN c ON c.id = ids.id AND c.switch_type = t.switch_type""")


def _stay_switch_sql(ids: list[str], where: str) -> str:
    g = ", ".join(ids)
    sel = f"{g}, " if ids else ""
    grp = f"GROUP BY {g}" if ids else ""
    return f"""
SELECT {sel}CAST(count(*) FILTER (WHERE switch = 0) AS BIGINT) AS stay,
       CAST(count(*) FILTER (WHERE switch = 1) AS BIGINT) AS switch,
       CAST(count(*) FILTER (WHERE switch = 1) AS DOUBLE) / nullif(count(*), 0) AS switch_prop,
       CAST(count(*) FILTER (WHERE switch = 0) AS DOUBLE) / nullif(count(*), 0) AS stay_prop
FROM trials WHERE {where} {grp}"""


_trial_query("switch_stay_overall", M.switch_stay_overall,
             with_trials() + _stay_switch_sql([], "switch IS NOT NULL"))
_trial_query("switch_stay_per_id", M.switch_stay_per_id,
             with_trials() + _stay_switch_sql(["id"], "switch IS NOT NULL"))
_trial_query("switch_stay_block", M.switch_stay_block, with_trials(
    "w AS (" + _stay_switch_sql(["id", "block"], "switch IS NOT NULL AND trial_type = 'free'") + ")",
    "l AS (" + _long("w", ["block"], ["switch_prop", "stay_prop"]) + ")") + summary_sql("l", ["block"]))

_TYPES = ["stay_loc", "stay_shape", "switch_loc", "switch_shape"]


def _type_counts(ids: list[str], where: str) -> str:
    g = ", ".join(ids)
    sel = f"{g}, " if ids else ""
    grp = f"GROUP BY {g}" if ids else ""
    cnt = ", ".join(f"CAST(count(*) FILTER (WHERE switch_type = '{t}') AS BIGINT) AS {t}" for t in _TYPES)
    return f"SELECT {sel}{cnt}, CAST(count(*) AS DOUBLE) AS tot_ FROM trials WHERE {where} {grp}"


_trial_query("switch_type_overall", M.switch_type_overall, with_trials(
    "w AS (" + _type_counts([], "switch_type IS NOT NULL") + ")") + """
SELECT stay_loc, stay_shape, switch_loc, switch_shape,
       switch_shape / nullif(tot_, 0) AS switch_diff_prop, switch_loc / nullif(tot_, 0) AS switch_easy_prop
FROM w""")
_trial_query("switch_type_block", M.switch_type_block, with_trials(
    "w AS (" + _type_counts(["id", "block"], "switch_type IS NOT NULL AND trial_type = 'free'") + ")",
    "p AS (SELECT block, " + ", ".join(f"{t} / nullif(tot_, 0) AS {t}_p" for t in _TYPES) + " FROM w)",
    "l AS (" + _long("p", ["block"], ["switch_shape_p", "switch_loc_p", "stay_shape_p", "stay_loc_p"]) + ")")
    + summary_sql("l", ["block"]))

# ================================================================ E14, E15: repetition bias

_trial_query("rep_bias_overall", M.rep_bias_overall, with_trials("""
o AS (SELECT CAST(count(*) FILTER (WHERE switch = 0 AND task_perf = 'loc') AS BIGINT) AS loc,
             CAST(count(*) FILTER (WHERE switch = 0 AND task_perf = 'shape') AS BIGINT) AS shape,
             CAST(count(*) FILTER (WHERE switch = 1) AS BIGINT) AS switches FROM trials),
p AS (SELECT *, CAST(loc AS DOUBLE) / nullif(loc + shape + switches, 0) AS loc_rep,
             CAST(shape AS DOUBLE) / nullif(loc + shape + switches, 0) AS shape_rep,
             CAST(switches AS DOUBLE) / nullif(loc + shape + switches, 0) AS switch FROM o)""") + """
SELECT loc, shape, switches, round_even(loc_rep + shape_rep + switch, 9) AS checkSum, type, prop FROM (
""" + _long("p", ["loc", "shape", "switches", "loc_rep", "shape_rep", "switch"],
            ["loc_rep", "shape_rep", "switch"], "type", "prop") + ")")


def _freq_sql(where: str) -> str:
    return f"""f AS (
  SELECT id, block, switch_type, count(*) AS n,
         round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY id, block), 1) AS prop
  FROM trials WHERE {where} AND switch_type IS NOT NULL AND id IS NOT NULL AND block IS NOT NULL
  GROUP BY id, block, switch_type),
w AS (SELECT id, block,
  {', '.join(f"first(prop) FILTER (WHERE switch_type = '{t}') AS {t}" for t in _TYPES)}
  FROM f GROUP BY id, block)"""


_trial_query("rep_bias_combined", M.rep_bias_combined, with_trials(
    _freq_sql("trial_type = 'free'"),
    "w2 AS (SELECT id, block, stay_loc, stay_shape, switch_loc + switch_shape AS switch FROM w)",
    "l AS (" + _long("w2", ["block"], ["stay_loc", "stay_shape", "switch"], "type", "prop") + ")",
    "ll AS (SELECT block, type, 'prop' AS variable, prop FROM l)")
    + summary_sql("ll", ["block", "type"], value="prop"))
_trial_query("rep_bias_only", M.rep_bias_only, with_trials(
    _freq_sql("trial_type = 'free' AND switch = 0"),
    "l AS (" + _long("w", ["block"], ["stay_loc", "stay_shape"], "type", "prop") + ")",
    "ll AS (SELECT block, type, 'prop' AS variable, prop FROM l)")
    + summary_sql("ll", ["block", "type"], value="prop"))

# ================================================================ E16: task selection


def _task_counts(ids: list[str]) -> str:
    g = ", ".join(ids)
    sel = f"{g}, " if ids else ""
    grp = f"GROUP BY {g}" if ids else ""
    return (f"SELECT {sel}CAST(count(*) FILTER (WHERE task_perf = 'loc') AS BIGINT) AS loc, "
            f"CAST(count(*) FILTER (WHERE task_perf = 'shape') AS BIGINT) AS shape "
            f"FROM trials WHERE task_perf != 'unknownTask' AND trial_type = 'free' {grp}")


def _task_overall_sql(ids: list[str]) -> str:
    sel = "".join(f"{i}, " for i in ids)
    return with_trials("w AS (" + _task_counts(ids) + ")",
                       f"w2 AS (SELECT {sel}CASE WHEN loc > 0 THEN loc END AS loc, "
                       "CASE WHEN shape > 0 THEN shape END AS shape FROM w)") + f"""
SELECT {sel}loc, shape, CAST(loc AS DOUBLE) / nullif(loc + shape, 0) AS easy_prop,
       CAST(shape AS DOUBLE) / nullif(loc + shape, 0) AS diff_prop FROM w2"""


_trial_query("task_selection_overall", M.task_selection_overall, _task_overall_sql([]))
_trial_query("task_selection_cbal_overall", lambda t: M.task_selection_overall(t, ("cBal",)),
             _task_overall_sql(["cBal"]))

_SEL = """sel AS (SELECT *, CAST(loc AS DOUBLE) / nullif(loc + shape, 0) AS easy_sel,
                    CAST(shape AS DOUBLE) / nullif(loc + shape, 0) AS diff_sel FROM w)"""
_trial_query("task_selection_id_block", M.task_selection_id_block,
             with_trials("w AS (" + _task_counts(["id", "block"]) + ")", _SEL) + "SELECT * FROM sel")
_trial_query("task_selection_block", M.task_selection_block, with_trials(
    "w AS (" + _task_counts(["id", "block"]) + ")", _SEL,
    "l AS (SELECT block, 'diff_sel' AS variable, diff_sel AS value FROM sel)") + summary_sql("l", ["block"]))
_trial_query("task_selection_long", M.task_selection_long, with_trials(
    "w AS (" + _task_counts(["id", "block"]) + ")", _SEL,
    "l AS (" + _long("sel", ["block"], ["easy_sel", "diff_sel"], "task_perf", "sel") + ")",
    "ll AS (SELECT block, task_perf, 'sel' AS variable, sel FROM l)")
    + summary_sql("ll", ["block", "task_perf"], value="sel"))
_trial_query("task_selection_counterbalance", M.task_selection_counterbalance, with_trials(
    "w AS (" + _task_counts(["id", "cBal", "block"]) + ")", _SEL,
    "l AS (SELECT cBal, block, 'diff_sel' AS variable, diff_sel AS value FROM sel)")
    + summary_sql("l", ["cBal", "block"]))

# ================================================================ E17: run lengths

_trial_query("running_switches", M.running_switches, with_trials(X2.split(",\nx2 AS")[0]) + """
SELECT id, countBal, cBal, block, blockNr, trialNr, trial_type, task_cued, t.task_perf, resp, rt, corr,
       switch_type, switch, p8.sumSwitch
FROM trials t JOIN p8 USING (id, block, blockNr, trialNr)""", scans=True)
_trial_query("run_lengths", M.run_lengths, with_trials(X2) + "SELECT * FROM x2", scans=True)
_trial_query("run_length_task", M.run_length_task, with_trials(
    X2, "l AS (SELECT task_perf, 'n' AS variable, n AS value FROM x2)") + summary_sql("l", ["task_perf"]), scans=True)
_trial_query("run_length_block_task", lambda t: M.run_length_task(t, ("block", "task_perf")), with_trials(
    X2, "l AS (SELECT block, task_perf, 'n' AS variable, n AS value FROM x2)")
    + summary_sql("l", ["block", "task_perf"]), scans=True)
_trial_query("run_length_id_task", M.run_length_id_task, with_trials(
    X2, "l AS (SELECT id, task_perf, 'n' AS variable, n AS value FROM x2 WHERE block = 'freeOnly')",
    "s AS (" + summary_sql("l", ["id", "task_perf"]) + ")") + """
SELECT nullif(id, 0) AS id, task_perf, nullif(n, 0) AS n, nullif(mean, 0) AS mean, nullif(se, 0) AS se FROM s""", scans=True)
_trial_query("run_length_skeleton", M.run_length_skeleton, with_trials(
    X2, "l AS (SELECT id, task_perf, 'n' AS variable, n AS value FROM x2 WHERE block = 'freeOnly')",
    "s AS (" + summary_sql("l", ["id", "task_perf"]) + ")",
    "fr AS (SELECT DISTINCT id, task_perf FROM x2)") + """
SELECT fr.id, fr.task_perf, s.variable, CAST(coalesce(s.n, 0) AS BIGINT) AS n, s.min, s.max, s.median,
       s.iqr, coalesce(s.mean, 0) AS mean, s.sd, s.se, s.ci
FROM fr LEFT JOIN s ON fr.id IS NOT DISTINCT FROM s.id AND fr.task_perf IS NOT DISTINCT FROM s.task_perf""", scans=True)
_trial_query("run_length_counterbalance", M.run_length_counterbalance, with_trials(
    X2, CBAL, "l AS (SELECT cb.cBal, x2.block, x2.task_perf, 'n' AS variable, x2.n AS value "
              "FROM x2 LEFT JOIN cb ON x2.id = cb.id)") + summary_sql("l", ["cBal", "block", "task_perf"]), scans=True)

# ================================================================ E18: accuracy

_trial_query("accuracy_switch", M.accuracy_switch, with_trials(
    _acc_sql("switch IS NOT NULL", "id, block, switch"),
    "l AS (SELECT block, switch, 'acc' AS variable, acc AS value FROM acc)") + summary_sql("l", ["block", "switch"]))
_trial_query("accuracy_task", M.accuracy_task, with_trials(
    _acc_sql("task_perf != 'unknownTask'", "id, block, task_perf"),
    "l AS (SELECT block, task_perf, 'acc' AS variable, acc AS value FROM acc)")
    + summary_sql("l", ["block", "task_perf"]))
_trial_query("accuracy_id", M.accuracy_id,
             with_trials(_acc_sql("switch_type IS NOT NULL", "id, block, switch_type")) + "SELECT * FROM acc")
_trial_query("accuracy_block_switch_type", lambda t: M.accuracy_block_switch_type(t, M.EXCLUDED_GROUPS), with_trials(
    _acc_sql("switch_type IS NOT NULL", "id, block, switch_type"),
    "l AS (SELECT block, switch_type, 'acc' AS variable, acc AS value FROM acc "
    "WHERE NOT (id = 107 AND switch_type = 'stay_loc'))",
    "s AS (" + summary_sql("l", ["block", "switch_type"]) + ")") + f"SELECT *, {ORDER_CASE} FROM s")

# ================================================================ E19, E20: RT

_trial_query("rt_by_switch_type", M.rt_by_switch_type, with_trials(
    "l AS (SELECT block, switch_type, 'rt' AS variable, rt AS value FROM trials WHERE switch_type IS NOT NULL)",
    "s AS (" + summary_sql("l", ["block", "switch_type"]) + ")") + f"""
SELECT *, round_even(mean - 2 * se, 3) AS lower, round_even(mean + 2 * se, 3) AS upper, {ORDER_CASE} FROM s""")
_trial_query("rt_per_id", M.rt_per_id, with_trials(
    "l AS (SELECT id, 'rt' AS variable, rt AS value FROM trials)") + summary_sql("l", ["id"]))
_trial_query("rt_caption", M.rt_caption, with_trials(
    "l AS (SELECT 'rt' AS variable, rt AS value FROM trials)", "s AS (" + summary_sql("l", []) + ")") + """
SELECT median, mean, concat_ws(' ', 'Med = ', CAST(median AS VARCHAR), '(s)' || chr(10), 'Mean = ',
       CAST(mean AS VARCHAR), '(s)') AS caption FROM s""")
_trial_query("check_vsr", M.check_vsr, with_trials(S2) + """
SELECT id, block, vsr, vsr_easy, vsr_diff,
       CASE WHEN round_even(vsr, 3) = round_even(vsr_easy + vsr_diff, 3) THEN 1 ELSE 0 END AS checkVsr FROM s2""")


def queries() -> dict[str, QueryFn]:
    from trialstats.plans import catalog_tables  # noqa: F401  (registers the rest)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from trialstats.plans import catalog_tables  # noqa: F401
    return dict(_SQL)
