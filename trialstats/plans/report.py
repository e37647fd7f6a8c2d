"""End-to-end report: the Spark form of the reference's scripts.

The reference runs one script top to bottom: read the logs, code the trials,
compute every table and save each one. Here the coded ``trials`` table is
written once to the shared checkpoint folder (so every metric starts from a
Parquet scan instead of re-running the coding, and a lost executor does not
send the work back to the raw logs), then each metric is computed from it and
written with the sink (S4).

    from trialstats.plans.report import run_report
    run_report(spark, trials_from_events(spark.read.parquet(".../events.parquet")), "/shared/out")
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialstats.operators import stats as S
from trialstats.plans import metrics as M
from trialstats.session import materialize
from trialstats.sources.sinks import write_summary

REPORT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "vsr": M.vsr,
    "vsr_decomposed": M.vsr_decomposed,
    "vsr_participant_mean": M.vsr_participant_mean,
    "vsr_summary_block": M.vsr_summary_block,
    "vsr_summary_block_difficulty": lambda t: M.vsr_summary_difficulty(t, ("block", "difficulty")),
    "switch_difference": M.switch_difference,
    "vsr_component_share": M.vsr_component_share,
    "vsr_mixed_long": M.vsr_mixed_long,
    "vsr_by_counterbalance": M.vsr_by_counterbalance,
    "switch_stay_block": M.switch_stay_block,
    "switch_type_block": M.switch_type_block,
    "rep_bias_combined": M.rep_bias_combined,
    "rep_bias_only": M.rep_bias_only,
    "task_selection_overall": M.task_selection_overall,
    "task_selection_block": M.task_selection_block,
    "task_selection_long": M.task_selection_long,
    "task_selection_counterbalance": M.task_selection_counterbalance,
    "run_length_block_task": lambda t: M.run_length_task(t, ("block", "task_perf")),
    "run_length_skeleton": M.run_length_skeleton,
    "run_length_counterbalance": M.run_length_counterbalance,
    "accuracy_switch": M.accuracy_switch,
    "accuracy_task": M.accuracy_task,
    "accuracy_block_switch_type": M.accuracy_block_switch_type,
    "accuracy_id": M.accuracy_id,
    "rt_by_switch_type": M.rt_by_switch_type,
    "rt_per_id": M.rt_per_id,
    "rt_histogram": lambda t: S.histogram(t, "rt", binwidth=0.1),
    "rt_density": lambda t: S.density(t, "rt"),
    "check_vsr": M.check_vsr,
}


def run_report(spark: SparkSession, trials: DataFrame, out_dir: str, fmt: str = "parquet",
               only: list[str] | None = None) -> dict[str, str]:
    """Materialize ``trials`` once, then write every report table under ``out_dir``; returns the paths."""
    coded = materialize(trials, "trials")
    paths = {}
    for name, metric in REPORT.items():
        if only and name not in only:
            continue
        path = os.path.join(out_dir, name)
        write_summary(metric(coded), path, fmt=fmt)
        paths[name] = path
    return paths
