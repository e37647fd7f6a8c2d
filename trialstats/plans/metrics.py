"""Metrics over the coded ``trials`` table (E1-E24) and the checks Q2, Q5.

Each function takes ``trials`` (see ``plans.trials``) and returns a lazy DataFrame.
Where the reference builds a count on each side of a join (VSR, accuracy), the
two sides are one aggregate here: one shuffle on the group key instead of a scan
and a shuffle per side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.operators import joins as J
from trialstats.operators import reshape as R
from trialstats.operators import stats as S
from trialstats.operators.columns import mutate_keep_unused
from trialstats.plans.trials import SEGMENT
from trialstats.operators.sequence import first_per, ordered_scan
from trialstats.session import materialize

SWITCH_TYPE_ORDER = ("stay_loc", "switch_loc", "stay_shape", "switch_shape")  # plot order of the reference
DIFFICULTY_LABELS = {"easy": "Easy", "diff": "Difficult"}
TASK_LABELS = {"loc": "Easy", "shape": "Difficult"}
EXCLUDED_GROUPS = ((107, "stay_loc"),)  # the one odd (id, switch_type) group that the reference's plot leaves out

def free() -> Column:
    return F.col("trial_type") == "free"


def known_switch() -> Column:
    return F.col("switch").isNotNull()


MEAN_DIGITS = 6  # output precision of plain means (summaries round to 3)


def _ratio(a: str | Column, b: str | Column) -> Column:
    return X.safe_divide(a, b)


# ---------------------------------------------------------------- E1, E2, E3 (VSR)

def vsr(trials: DataFrame, keys: Sequence[str] = ("id", "block"), free_only: bool = True) -> DataFrame:
    """Voluntary switch rate = switches / trials with known switch status, rounded to 3."""
    base = trials.where(known_switch() & free()) if free_only else trials.where(known_switch())
    return (base.groupBy(*keys)
            .agg(F.sum("switch").alias("switch_sum"), F.count(F.lit(1)).alias("n"))
            .withColumn("vsr", F.bround(F.col("switch_sum") / F.col("n"), 3)))


def vsr_decomposed(trials: DataFrame, keys: Sequence[str] = ("id", "block"), keep_lonely_easy: bool = False) -> DataFrame:
    """E2 + J3: VSR split into easy (→ loc) and difficult (→ shape) switches, missing → 0.

    The reference joins the easy counts onto the difficult counts, so a group with easy
    but no difficult switches loses its easy count (→ 0). That is kept by default;
    ``keep_lonely_easy=True`` counts them.
    """
    base = trials.where(known_switch() & free())
    diff = F.count_if(F.col("switch_type") == "switch_shape")
    easy = F.count_if(F.col("switch_type") == "switch_loc")
    easy_kept = easy if keep_lonely_easy else F.when(diff > 0, easy).otherwise(F.lit(0).cast("long"))
    out = base.groupBy(*keys).agg(
        F.sum("switch").alias("switch_sum"), easy_kept.alias("switch_easy"), diff.alias("switch_diff"),
        F.count(F.lit(1)).alias("n"))
    return out.withColumns({
        "vsr": F.bround(F.col("switch_sum") / F.col("n"), 3),
        "vsr_easy": F.coalesce(_ratio("switch_easy", "n"), F.lit(0.0)),
        "vsr_diff": F.coalesce(_ratio("switch_diff", "n"), F.lit(0.0)),
    })


def vsr_participant_mean(trials: DataFrame) -> DataFrame:
    """E3 + J4: add the per-participant mean of vsr, vsr_easy, vsr_diff (NA-propagating mean)."""
    s2 = vsr_decomposed(trials)
    out = J.with_group_mean(s2, ["id"], {"vsr_avg": "vsr", "vsr_easy_avg": "vsr_easy", "vsr_diff_avg": "vsr_diff"})
    return out.withColumns({c: F.bround(c, MEAN_DIGITS) for c in ("vsr_avg", "vsr_easy_avg", "vsr_diff_avg")})


def vsr_long(s: DataFrame, ids: Sequence[str]) -> DataFrame:
    """VSR by difficulty in long form: ``difficulty`` ∈ {easy, diff}, value ``vsr_difficulty``."""
    return R.pivot_longer(s, ids, ["vsr_easy", "vsr_diff"], "difficulty", "vsr_difficulty", names_prefix="vsr_")


def vsr_summary_difficulty(trials: DataFrame, keys: Sequence[str] = ("difficulty",)) -> DataFrame:
    """Full summary of VSR per difficulty (and per block / id, block with ``keys``)."""
    long = vsr_long(vsr_decomposed(trials), ["id", "block"])
    return S.summary_stats(long, list(keys), ["vsr_difficulty"], kind="full")


def vsr_summary_block(trials: DataFrame) -> DataFrame:
    """E5: common summary of VSR per block."""
    return S.summary_stats(vsr(trials), ["block"], ["vsr"])


def switch_difference(trials: DataFrame) -> DataFrame:
    """Easy minus difficult switches per (id, block), summarised per block."""
    s2 = vsr_decomposed(trials).withColumn("switch_difference", F.col("switch_easy") - F.col("switch_diff"))
    return S.summary_stats(s2, ["block"], ["switch_difference"])


def vsr_component_share(trials: DataFrame, keys: Sequence[str] = ("block", "vsr_type")) -> DataFrame:
    """Share of easy / difficult switches among all switches (0/0 → missing), summarised."""
    s2 = vsr_decomposed(trials)
    total = F.col("vsr_diff") + F.col("vsr_easy")
    s2 = s2.withColumns({"vsr_easy_prop": _ratio("vsr_easy", total), "vsr_diff_prop": _ratio("vsr_diff", total)})
    long = R.pivot_longer(s2, ["id", "block"], ["vsr_easy_prop", "vsr_diff_prop"], "vsr_type", "vsr_prop")
    return S.summary_stats(long, list(keys), ["vsr_prop"])


def vsr_mixed_long(trials: DataFrame) -> DataFrame:
    """VSR per participant and difficulty in the mixed block, with display labels."""
    s3 = vsr_participant_mean(trials).where(F.col("block") == "mixed")
    keep = [c for c in s3.columns if c not in ("vsr_easy", "vsr_diff")]
    long = vsr_long(s3, keep)
    return long.withColumn("difficulty_label", R.relabel("difficulty", DIFFICULTY_LABELS))


def participant_attributes(trials: DataFrame, cols: Sequence[str] = ("cBal",)) -> DataFrame:
    """First row per participant (in trial order) → (id, attributes)."""
    return first_per(trials.select("id", "blockNr", "trialNr", *cols), ["id"], ["blockNr", "trialNr"]) \
        .select("id", *cols)


def vsr_by_counterbalance(trials: DataFrame) -> DataFrame:
    """E9 + J2: VSR summary per block order and block.

    The reference joins each participant's first-row ``cBal`` onto the VSR table. ``cBal``
    is a function of the participant id, so carrying it as a grouping key of the same
    aggregate gives the same table from one pass over the trials (no second scan, no join).
    """
    return S.summary_stats(vsr(trials, keys=("id", "cBal", "block")), ["cBal", "block"], ["vsr"])


def counterbalance_of(trials: DataFrame) -> DataFrame:
    """The block order (``cBal``) on each participant's first row, the right side of the reference's join."""
    return first_per(trials, ["id"], ["blockNr", "trialNr"]).select("id", "cBal")


# ---------------------------------------------------------------- E10-E13 (switch / stay shares)

def switch_types_per_id(trials: DataFrame) -> DataFrame:
    """E10 + R3: switches of each type per participant, absent types completed with 0."""
    counts = S.count_by(trials.where(known_switch()), ["id", "switch_type"])
    return R.complete_by_round_trip(counts, ["id"], "switch_type", "n", list(SWITCH_TYPES_ALPHA), fill=0)


SWITCH_TYPES_ALPHA = ("stay_loc", "stay_shape", "switch_loc", "switch_shape")


def _stay_switch_wide(base: DataFrame, ids: Sequence[str]) -> DataFrame:
    counts = S.count_by(base.withColumn("_sw", F.col("switch").cast("int")), [*ids, "_sw"])
    wide = R.pivot_wider(counts, ids, "_sw", "n", [0, 1], names={0: "stay", 1: "switch"})
    wide = wide.fillna(0, subset=["stay", "switch"])
    return wide.withColumns({"switch_prop": _ratio("switch", F.col("switch") + F.col("stay")),
                             "stay_prop": _ratio("stay", F.col("switch") + F.col("stay"))})


def switch_stay_overall(trials: DataFrame) -> DataFrame:
    """Numbers and shares of stay and switch trials over all trials."""
    return _stay_switch_wide(trials.where(known_switch()), [])


def switch_stay_per_id(trials: DataFrame) -> DataFrame:
    """The same per participant."""
    return _stay_switch_wide(trials.where(known_switch()), ["id"])


def switch_stay_block(trials: DataFrame) -> DataFrame:
    """Shares per (id, block) over free trials, zero-filled, then summarised per block."""
    wide = _stay_switch_wide(trials.where(known_switch() & free()), ["id", "block"])
    return S.summary_stats(wide, ["block"], ["switch_prop", "stay_prop"])


def _switch_type_wide(base: DataFrame, ids: Sequence[str]) -> DataFrame:
    counts = S.count_by(base, [*ids, "switch_type"])
    wide = R.pivot_wider(counts, ids, "switch_type", "n", list(SWITCH_TYPES_ALPHA))
    return wide.fillna(0, subset=list(SWITCH_TYPES_ALPHA))


def switch_type_overall(trials: DataFrame) -> DataFrame:
    """The four switch types and the difficult / easy switch shares over all trials."""
    wide = _switch_type_wide(trials.where(F.col("switch_type").isNotNull()), [])
    return wide.withColumns({
        "switch_diff_prop": S.share(["switch_shape"], SWITCH_TYPES_ALPHA)["switch_shape"],
        "switch_easy_prop": S.share(["switch_loc"], SWITCH_TYPES_ALPHA)["switch_loc"],
    })


def switch_type_block(trials: DataFrame) -> DataFrame:
    """Share of each switch type per (id, block) over free trials, summarised per block."""
    wide = _switch_type_wide(trials.where(F.col("switch_type").isNotNull() & free()), ["id", "block"])
    shares = S.share(list(SWITCH_TYPES_ALPHA))
    wide = wide.withColumns({f"{c}_p": e for c, e in shares.items()})
    return S.summary_stats(wide, ["block"], ["switch_shape_p", "switch_loc_p", "stay_shape_p", "stay_loc_p"])


# ---------------------------------------------------------------- E14, E15 (repetition bias)

def rep_bias_overall(trials: DataFrame) -> DataFrame:
    """E14 + J5 + Q5: loc / shape repetitions and switches as shares of all coded trials, long."""
    one = trials.agg(
        F.count_if((F.col("switch") == 0) & (F.col("task_perf") == "loc")).alias("loc"),
        F.count_if((F.col("switch") == 0) & (F.col("task_perf") == "shape")).alias("shape"),
        F.count_if(F.col("switch") == 1).alias("switches"))
    total = F.col("loc") + F.col("shape") + F.col("switches")
    one = one.withColumns({"loc_rep": _ratio("loc", total), "shape_rep": _ratio("shape", total),
                           "switch": _ratio("switches", total)})
    one = one.withColumn("checkSum", F.bround(F.col("loc_rep") + F.col("shape_rep") + F.col("switch"), 9))
    return R.pivot_longer(one, ["loc", "shape", "switches", "checkSum"], ["loc_rep", "shape_rep", "switch"],
                          "type", "prop")


def _freq_wide(base: DataFrame, levels: Sequence[str]) -> DataFrame:
    ft = S.freq_table(base, ["id", "block", "switch_type"]).drop("n")
    return R.pivot_wider(ft, ["id", "block"], "switch_type", "prop", list(levels))


def rep_bias_combined(trials: DataFrame) -> DataFrame:
    """Percent of stay-loc, stay-shape and (both) switches per (id, block), summarised.

    ``switch = switch_loc + switch_shape`` is null when either is missing (as in R).
    """
    wide = _freq_wide(trials.where(free()), SWITCH_TYPES_ALPHA)
    wide = mutate_keep_unused(wide, "switch", F.col("switch_loc") + F.col("switch_shape"),
                              ["switch_loc", "switch_shape"])
    long = R.pivot_longer(wide, ["id", "block"], ["stay_loc", "stay_shape", "switch"], "type", "prop")
    return S.summary_stats(long, ["block", "type"], ["prop"])


def rep_bias_only(trials: DataFrame) -> DataFrame:
    """Repetitions only: percent of stay-loc and stay-shape per (id, block), summarised."""
    wide = _freq_wide(trials.where(free() & (F.col("switch") == 0)), ("stay_loc", "stay_shape"))
    long = R.pivot_longer(wide, ["id", "block"], ["stay_loc", "stay_shape"], "type", "prop")
    return S.summary_stats(long, ["block", "type"], ["prop"])


# ---------------------------------------------------------------- E16 (task selection)

def _task_wide(trials: DataFrame, ids: Sequence[str]) -> DataFrame:
    base = trials.where(X.not_in("task_perf", ["unknownTask"]) & free())
    counts = S.count_by(base, [*ids, "task_perf"])
    return R.pivot_wider(counts, ids, "task_perf", "n", ["loc", "shape"])


def task_selection_overall(trials: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Free choices of the easy / difficult task, as counts and shares."""
    wide = _task_wide(trials, ids)
    tot = F.col("loc") + F.col("shape")
    return wide.withColumns({"easy_prop": _ratio("loc", tot), "diff_prop": _ratio("shape", tot)})


def task_selection_id_block(trials: DataFrame, ids: Sequence[str] = ("id", "block")) -> DataFrame:
    """E16 + N3: per (id, block), zero-filled counts and the share of difficult choices."""
    wide = _task_wide(trials, ids).fillna(0, subset=["loc", "shape"])
    tot = F.col("loc") + F.col("shape")
    return wide.withColumns({"easy_sel": _ratio("loc", tot), "diff_sel": _ratio("shape", tot)})


def task_selection_block(trials: DataFrame) -> DataFrame:
    """Share of difficult choices per (id, block), summarised per block."""
    return S.summary_stats(task_selection_id_block(trials), ["block"], ["diff_sel"])


def task_selection_long(trials: DataFrame) -> DataFrame:
    """Easy and difficult shares in long form, summarised per block and task."""
    wide = task_selection_id_block(trials)
    long = R.pivot_longer(wide, ["id", "block"], ["easy_sel", "diff_sel"], "task_perf", "sel")
    return S.summary_stats(long, ["block", "task_perf"], ["sel"])


def task_selection_counterbalance(trials: DataFrame) -> DataFrame:
    """Share of difficult choices per (id, block order, block), summarised per (cBal, block)."""
    wide = task_selection_id_block(trials, ("id", "cBal", "block"))
    return S.summary_stats(wide, ["cBal", "block"], ["diff_sel"])


# ---------------------------------------------------------------- E17 (run lengths)

def running_switches(trials: DataFrame, keys: Sequence[str] = ("id", "block", "blockNr")) -> DataFrame:
    """Running count of switches in (id, block, blockNr) over free trials with a known status.

    Trials that still carry the segment of their coding (``trials_from_events(with_segment=True)``) are not ranked again.
    """
    base = trials.where(known_switch() & free())
    segment = F.col(SEGMENT) if SEGMENT in trials.columns else None
    return ordered_scan(base, list(keys), ["trialNr"], running_sum={"sumSwitch": "switch"}, segment=segment).drop(SEGMENT)


def run_lengths(trials: DataFrame, keys: Sequence[str] = ("id", "block", "blockNr")) -> DataFrame:
    """Trials per run (id, block, blockNr, running switches, task) — gaps and islands."""
    return S.count_by(running_switches(trials, keys), [*keys, "sumSwitch", "task_perf"])


def run_length_task(trials: DataFrame, keys: Sequence[str] = ("task_perf",)) -> DataFrame:
    """Summary of run lengths per task (pilot 3) or per (block, task)."""
    return S.summary_stats(run_lengths(trials), list(keys), ["n"])


def run_length_id_task(trials: DataFrame) -> DataFrame:
    """Free-only block, per (id, task); zeros replaced by missing in every numeric column."""
    x2 = run_lengths(trials).where(F.col("block") == "freeOnly")
    st = S.summary_stats(x2, ["id", "task_perf"], ["n"])
    num = [c for c, t in st.dtypes if t in ("int", "bigint", "double")]
    st = st.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(dict(st.dtypes)[c])) for c in num})
    return st.select("id", "task_perf", "n", "mean", "se")


def run_length_skeleton(trials: DataFrame) -> DataFrame:
    """E17 + J6 + N7: every (id, task) of the run table, with the free-block summary or 0."""
    x2 = materialize(run_lengths(trials), "runs")  # read for the frame and for the statistics
    st = S.summary_stats(x2.where(F.col("block") == "freeOnly"), ["id", "task_perf"], ["n"])
    out = J.complete_left(x2, ["id", "task_perf"], st)
    return out.withColumns({"n": X.if_null("n", 0), "mean": X.if_null("mean", 0.0)})


def run_length_counterbalance(trials: DataFrame) -> DataFrame:
    """E17 + J2: run-length summary per block order, block and task (``cBal`` carried as a key of
    the per-participant grouping, as in ``vsr_by_counterbalance``)."""
    x2 = run_lengths(trials, keys=("id", "cBal", "block", "blockNr"))
    return S.summary_stats(x2, ["cBal", "block", "task_perf"], ["n"])


# ---------------------------------------------------------------- E18 (accuracy)

def accuracy_table(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Σcorr / n per group; null corr counts in n but not in the sum (``na.rm = TRUE``)."""
    return (base.groupBy(*keys)
            .agg(F.coalesce(F.sum(F.col("corr").cast("long")), F.lit(0).cast("long")).alias("sumCorr"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("acc", _ratio("sumCorr", "n")))


def accuracy_switch(trials: DataFrame) -> DataFrame:
    """Accuracy on stay vs switch trials per (id, block), summarised per (block, switch)."""
    acc = accuracy_table(trials.where(known_switch()), ["id", "block", "switch"])
    return S.summary_stats(acc, ["block", "switch"], ["acc"])


def accuracy_task(trials: DataFrame) -> DataFrame:
    """Accuracy on the easy vs difficult task, summarised per (block, task)."""
    acc = accuracy_table(trials.where(X.not_in("task_perf", ["unknownTask"])), ["id", "block", "task_perf"])
    return S.summary_stats(acc, ["block", "task_perf"], ["acc"])


def accuracy_id(trials: DataFrame, keys: Sequence[str] = ("id", "block", "switch_type")) -> DataFrame:
    """Accuracy per (id, block, switch type), or per (id, switch type) over both blocks."""
    return accuracy_table(trials.where(F.col("switch_type").isNotNull()), list(keys))


def accuracy_switch_type(trials: DataFrame) -> DataFrame:
    """E18 + A13 + O3: accuracy per (id, switch type), summarised per switch type with ±2·se bars, in plot order."""
    st = S.summary_stats(accuracy_id(trials, ("id", "switch_type")), ["switch_type"], ["acc"])
    return R.with_order(S.with_error_bars(st), "switch_type", SWITCH_TYPE_ORDER)


def accuracy_block_switch_type(trials: DataFrame, exclude: Sequence[tuple] = ()) -> DataFrame:
    """E18 + F10 + O3: accuracy per switch type without the (id, switch type) groups of ``exclude``, summarised, in plot order."""
    acc = accuracy_id(trials)
    for gid, gtype in exclude:
        acc = acc.where(~(F.col("id").eqNullSafe(gid) & F.col("switch_type").eqNullSafe(gtype)))
    st = S.summary_stats(acc, ["block", "switch_type"], ["acc"])
    return R.with_order(st, "switch_type", SWITCH_TYPE_ORDER)


# ---------------------------------------------------------------- E19, E20 (RT)

def rt_by_switch_type(trials: DataFrame, keys: Sequence[str] = ("block", "switch_type")) -> DataFrame:
    """E19 + A13 + O3: RT summary per (block, switch type), or per switch type, with ±2·se bars, in plot order."""
    st = S.summary_stats(trials.where(F.col("switch_type").isNotNull()), list(keys), ["rt"])
    return R.with_order(S.with_error_bars(st), "switch_type", SWITCH_TYPE_ORDER)


def rt_per_id(trials: DataFrame) -> DataFrame:
    """RT summary per participant."""
    return S.summary_stats(trials, ["id"], ["rt"])


def rt_caption(trials: DataFrame, unit: str = "(s)") -> DataFrame:
    """X7 + A12: median and mean RT (rounded to 3) and the caption text of the plot."""
    st = S.summary_stats(trials, [], ["rt"]).select("median", "mean")
    return st.withColumn("caption", X.paste("Med = ", F.col("median"), f"{unit}\n", "Mean = ", F.col("mean"), unit))


# ---------------------------------------------------------------- Q2

def check_vsr(trials: DataFrame) -> DataFrame:
    """Q2: 1 when round(vsr, 3) == round(vsr_easy + vsr_diff, 3), else 0 (null → 0)."""
    s2 = vsr_decomposed(trials)
    ok = F.bround("vsr", 3) == F.bround(F.col("vsr_easy") + F.col("vsr_diff"), 3)
    return s2.select("id", "block", "vsr", "vsr_easy", "vsr_diff",
                     F.when(ok, F.lit(1)).otherwise(F.lit(0)).alias("checkVsr"))
