"""Trial coding (D1-D12): from raw logs or from the driver's ``events`` table to ``trials``.

Two inputs give the same coded table:

* ``trials_from_events`` — the projection of ``events`` fixed in FIXTURES.md §3
  (one event = one trial of user ``id``).
* ``code_trials`` — the reference's chain over wide per-counterbalance logs:
  drop practice rows, back-fill the block number, collapse the one-hot
  columns, code the performed task, then ``lag`` inside (id, block number).
  ``wide_logs_from_events`` writes ``events`` in that wide shape, so the chain
  can be checked end to end against ``trials_from_events``.

Both code the switch type **before** the unknown-accuracy and double-response
filters (the reference does the same), so a dropped trial still counts as the
"previous" trial of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.operators.sequence import ordered_scan, ranged

# ----------------------------------------------------------------------------------
# Fixed values of the experiment (they must equal the reference's codes).
CUE_TO_TASK = {"JAKI": "shape", "GDZIE": "loc", "XXXX": "any"}   # cue word -> cued task
UNKNOWN_TASK = "unknownTask"
EASY_TASK, DIFFICULT_TASK = "loc", "shape"
SWITCH_TYPES = ("stay_loc", "stay_shape", "switch_loc", "switch_shape")
BLOCK_KINDS = {"mixed": "mix", "freeOnly": "free"}                # block -> column suffix
COUNTERBALANCES = (1, 2, 3, 4)
NO_KEY, NOT_ASKED, UNKNOWN_CORR = "None", 888, 999
# ----------------------------------------------------------------------------------

TRIAL_COLUMNS = ["id", "countBal", "cBal", "block", "blockNr", "trialNr", "trial_type",
                 "task_cued", "task_perf", "resp", "rt", "corr", "switch_type", "switch"]
# the reference's full coded table: stimulus columns too, in its order
STIMULUS_COLUMNS = {"Type": "type", "Location": "location", "Shape": "shape", "cue_follow": "cuefol"}  # log column -> coded column
FULL_COLUMNS = ["id", "countBal", "cBal", "type", "location", "shape", "trial_type", "block", "task_cued", "task_perf", "cuefol",
                "blockNr", "trialNr", "resp", "rt", "corr", "switch_type", "switch"]
SEGMENT = "scan_segment"  # optional last column: never falls along (id, blockNr, trialNr)


# ---------------------------------------------------------------- D1, D2, D6, D9, D10

def counterbalance(id_col: str | Column) -> Column:
    """Id mod 4 with 0 mapped to 4 (R's ``%%``, so negative ids stay in 1..4)."""
    m = X.rmod(id_col, 4)
    return F.when(m == 0, F.lit(4)).otherwise(m).cast("int")


def block_order(countbal: str | Column) -> Column:
    """Counterbalances 1, 3 start with the mixed block, 2, 4 with the free-only block."""
    c = X.col(countbal)
    return F.when(c.isin(1, 3), F.lit("mix-free")).when(c.isin(2, 4), F.lit("free-mix"))


def cued_task(cue: str | Column) -> Column:
    """Cue word to the task it asks for, anything else ``unknownTask``."""
    c = X.col(cue)
    return X.case_when([(c == k, v) for k, v in CUE_TO_TASK.items()], default=UNKNOWN_TASK)


def switch_type(task: str | Column, prev_task: str | Column, unknown: str | None = None) -> Column:
    """Stay / switch to the current task; otherwise null (pilots 4+) or ``unknown``
    (pilots 2-3 use 'unknownSwitch')."""
    t, p = X.col(task), X.col(prev_task)
    return X.case_when([
        ((t == "shape") & (p == "shape"), "stay_shape"),
        ((t == "loc") & (p == "loc"), "stay_loc"),
        ((t == "shape") & (p == "loc"), "switch_shape"),
        ((t == "loc") & (p == "shape"), "switch_loc"),
    ], default=unknown)


def switch_flag(stype: str | Column) -> Column:
    """Stay -> 0, switch -> 1, else null (double, as R's ``NA_real_`` column)."""
    s = X.col(stype)
    return (F.when(s.isin("stay_shape", "stay_loc"), F.lit(0.0))
            .when(s.isin("switch_shape", "switch_loc"), F.lit(1.0)))


def keep_scored(df: DataFrame) -> DataFrame:
    """F6 + F7: drop unknown accuracy (``corr < 999``, also drops null) and double responses."""
    return df.where((F.col("corr") < UNKNOWN_CORR) & (F.length("resp") <= 1))


def code_switches(df: DataFrame, keys=("id", "blockNr"), order=("trialNr",), segment: Column | None = None,
                  row_number: str | None = None, unknown: str | None = None) -> DataFrame:
    """W1 + D9 + D10: lag of ``task_perf`` in (id, blockNr), then type and 0/1 flag.

    The pilots 2-3 rule (§2.16 #6) is ``keys=("id",)`` — the lag crosses block
    starts — with ``unknown='unknownSwitch'``.
    """
    scanned = ordered_scan(df, list(keys), list(order), lag={"_prev_task": "task_perf"},
                           row_number=row_number, segment=segment)
    return (scanned.withColumn("switch_type", switch_type("task_perf", "_prev_task", unknown))
            .withColumn("switch", switch_flag("switch_type"))
            .drop("_prev_task"))


# ---------------------------------------------------------------- events fixture (FIXTURES.md §3)

def events_as_trials(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per-event projection to trial columns (no ordering yet); ``keep``: the working column ``_k`` too."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    et = F.col("event_type")
    task_perf = (F.when(et.isin("click", "view"), F.lit("loc"))
                 .when(et.isin("purchase", "signup"), F.lit("shape"))
                 .when(et == "error", F.lit("shapeloc")))
    e = events.select(
        F.col("ts"), F.col("event_id"),
        F.col("user_id").cast("long").alias("id"),  # ids at scale exceed 32 bits
        k.alias("_k"),
        (F.floor((F.dayofmonth("ts") - 1) / 8) + 1).cast("int").alias("blockNr"),
        task_perf.alias("task_perf"),
        (F.col("value") / 100).alias("rt"),
        et.alias("event_type"),
    )
    e = e.withColumn("countBal", counterbalance("id"))
    in_mixed = (F.col("blockNr") <= 2) == F.col("countBal").isin(1, 3)
    e = e.withColumns({
        "cBal": block_order("countBal"),
        "block": F.when(in_mixed, F.lit("mixed")).otherwise(F.lit("freeOnly")),
    })
    km3 = X.rmod("_k", 3)
    e = e.withColumns({
        "trial_type": F.when((F.col("block") == "freeOnly") | (km3 == 0), F.lit("free")).otherwise(F.lit("forced")),
        "cue": F.when(km3 == 0, F.lit("XXXX")).when(km3 == 1, F.lit("JAKI")).when(km3 == 2, F.lit("GDZIE")),
        "corr": F.when(F.col("_k") >= 98, F.lit(999))
                 .when(X.rmod("_k", 10) < 8, F.lit(1)).otherwise(F.lit(0)).cast("int"),
        "resp": F.when(F.col("task_perf") == "shapeloc", F.lit(""))
                 .when(F.col("_k") == 42, F.lit("xm"))
                 .when(F.col("task_perf") == "loc", F.lit("x"))
                 .otherwise(F.lit("m")),
    })
    e = e.withColumns({
        "type": F.initcap(F.col("event_type")),
        "location": F.when(X.rmod("_k", 2) == 0, F.lit("left")).otherwise(F.lit("right")),
        "shape": F.when(X.rmod("_k", 5) < 2, F.lit("circle")).otherwise(F.lit("square")),
        "cuefol": F.when(F.col("trial_type") == "forced", F.when(F.col("task_perf") == cued_task("cue"), F.lit("yes")).otherwise(F.lit("no"))),
    })
    return e.withColumn("task_cued", cued_task("cue")).drop("event_type", *([] if keep else ["_k"]))


def coded_events(events: DataFrame) -> DataFrame:
    """All events with trial number and switch coding, before the scored-trial filters; the last column is the scan's segment."""
    coded = [c for c in TRIAL_COLUMNS if c not in ("trialNr", "switch_type", "switch")]
    e = events_as_trials(events).select("ts", "event_id", *coded)  # what is written is what is used
    e = ranged(e, ["id", "blockNr"], ["ts", "event_id"], SEGMENT)
    return code_switches(e, keys=("id", "blockNr"), order=("ts", "event_id"), segment=F.col(SEGMENT), row_number="trialNr")


def trials_from_events(events: DataFrame, with_segment: bool = False) -> DataFrame:
    """The ``trials`` table (D12) from ``events``; ``with_segment`` keeps the column that later scans along trialNr can use."""
    return keep_scored(coded_events(events)).select(*TRIAL_COLUMNS, *([SEGMENT] if with_segment else []))


# ---------------------------------------------------------------- wide logs (FIXTURES.md §3, last part)

def wide_name(task: str, cb: int, kind: str, field: str) -> str:
    """Name of a one-hot response column, dots already turned to '_' (rule 14)."""
    return f"both_{task}_cb{cb}_{kind}_{field}"


def loop_name(loop: str, kind: str, cb: int, field: str) -> str:
    """Name of a loop counter column, e.g. ``nBlocksMixCb1_thisRepN``."""
    return f"n{loop}{kind.capitalize()}Cb{cb}_{field}"


RESPONSE_COLUMNS = [wide_name(t, cb, kind, f) for cb in COUNTERBALANCES for kind in ("mix", "free")
                    for t in ("shape", "loc") for f in ("keys", "rt", "corr")]
LOOP_FIELDS = ("thisRepN", "thisTrialN", "thisN", "thisIndex")


def _loop_value(loop: str, field: str) -> Column:
    """A loop counter of the fixture: the block's, or that of the trial's position in its block."""
    if loop == "Blocks":
        nr = F.col("blockNr")
        return {"thisRepN": nr - 1, "thisTrialN": nr % 2, "thisN": nr + 3, "thisIndex": nr * 7}[field]
    pos = F.col("_pos")
    return {"thisRepN": F.floor(pos / 16), "thisTrialN": pos % 16, "thisN": pos, "thisIndex": pos + 100}[field]


def wide_logs_from_events(events: DataFrame) -> DataFrame:
    """Write ``events`` as the reference's wide logs: one column per counterbalance x block kind x task.

    Only the matching column of a row holds the response; of the other key columns half hold
    'None', of the other corr columns half hold '888' (both mean "no value"). The rt and corr of a
    no-response trial sit in the ``loc`` columns. ``nBlocks*_thisRepN`` is set on the last trial of
    a block only, so the block number has to be back-filled. Everything is text, as read from CSV.
    """
    e = events_as_trials(events)
    e = ranged(e, ["id", "blockNr"], ["ts", "event_id"], SEGMENT)
    # position in the block from the end (1 = last trial)
    e = ordered_scan(e, ["id", "blockNr"], ["ts", "event_id"], row_number="_from_end", segment=F.col(SEGMENT), descending=True)
    kind = F.when(F.col("block") == "mixed", F.lit("mix")).otherwise(F.lit("free"))
    resp_task = F.when(F.col("task_perf") == "shapeloc", F.lit("loc")).otherwise(F.col("task_perf"))
    odd = X.rmod(F.col("event_id"), 2) == 1
    cols: dict[str, Column] = {}
    for cb in COUNTERBALANCES:
        for kd in ("mix", "free"):
            here = (F.col("countBal") == cb) & (kind == kd)
            for t in ("shape", "loc"):
                active = here & (resp_task == t)
                key_val = F.when(F.col("task_perf") == t, F.col("resp"))  # no-response rows press nothing
                cols[wide_name(t, cb, kd, "keys")] = F.when(active & key_val.isNotNull(), key_val) \
                    .when(~odd, F.lit(NO_KEY))
                cols[wide_name(t, cb, kd, "rt")] = F.when(active, F.col("rt").cast("string"))
                cols[wide_name(t, cb, kd, "corr")] = F.when(active, F.col("corr").cast("string")) \
                    .when(odd, F.lit(str(NOT_ASKED)))
            for loop in ("Blocks", "Trials"):
                shown = here & (F.col("_from_end") == 1) if loop == "Blocks" else here
                for f in LOOP_FIELDS:
                    cols[loop_name(loop, kd, cb, f)] = F.when(shown, _loop_value(loop, f).cast("string"))
    e = ordered_scan(e, ["id", "blockNr"], ["ts", "event_id"], row_number="_rn", segment=F.col(SEGMENT))
    e = e.withColumn("_pos", F.col("_rn") - 1)
    out = e.select(
        F.col("id").cast("string").alias("participant"),
        F.col("ts"), F.col("event_id"),
        F.col("cue").alias("Cue"),
        F.col("trial_type").alias("Task"),
        F.col("block").alias("Block"),
        *[F.col(c).alias(n) for n, c in STIMULUS_COLUMNS.items()],
        *[c.alias(n) for n, c in cols.items()],
    )
    return out


def pilot2_logs_from_events(events: DataFrame) -> DataFrame:
    """``events`` as logs of pilots 2-3: key, time and accuracy columns of two counterbalances (the first for odd ids), as text.

    With k = 13 a key of the other task is pressed too (unknown task); with k = 14 the other counterbalance's column of the same task
    holds a key as well (unknown response); ``error`` events have no key at all.
    """
    e = events_as_trials(events, keep=["_k"])
    first = X.rmod("id", 2) == 1
    cols = {}
    for t in ("shape", "loc"):
        other = "loc" if t == "shape" else "shape"
        for cb in (1, 2):
            here = (F.col("task_perf") == t) & (first if cb == 1 else ~first)
            both = (F.col("task_perf") == other) & (first if cb == 1 else ~first) & (F.col("_k") == 13)
            beside = (F.col("task_perf") == t) & (~first if cb == 1 else first) & (F.col("_k") == 14)
            cols[f"both_{t}_cb{cb}_keys"] = F.when(here, F.col("resp")).when(both, F.lit("b")).when(beside, F.lit("q"))
            cols[f"both_{t}_cb{cb}_rt"] = F.when(here, F.col("rt").cast("string"))
            cols[f"both_{t}_cb{cb}_corr"] = F.when(here, F.col("corr").cast("string"))
    return e.select("id", "ts", "event_id", *[c.alias(n) for n, c in cols.items()])


def _lower_match(columns, prefix: str, suffix: str) -> list[str]:
    p, s = prefix.lower(), suffix.lower()
    return [c for c in columns if c.lower().startswith(p) and c.lower().endswith(s)]


def collapsed_loops(wide: DataFrame, keep: list[str]) -> DataFrame:
    """The counters of all counterbalances and block kinds as eight integer columns, ``nBlocks_thisRepN`` to ``nTrials_thisIndex``."""
    out = {f"n{loop}_{f}": X.to_int(X.unite([F.nullif(F.col(c), F.lit("")) for c in _lower_match(wide.columns, f"n{loop}", f"_{f}")]))
           for loop in ("Blocks", "Trials") for f in LOOP_FIELDS}
    return wide.select(*keep, *[e.alias(n) for n, e in out.items()])


def code_trials(wide: DataFrame, keys_order=("ts", "event_id"), file_key: str = "participant",
                segment: Column | None = None, stimulus: bool = False) -> DataFrame:
    """The reference's coding chain over wide logs, as one lazy plan.

    ``keys_order`` is the row order inside a file; ``file_key`` the column that
    tells files apart (the back-fill of the block number must not cross files). ``segment``: a
    column that never falls along the row order of a file, where there is one. ``stimulus`` keeps the
    stimulus columns too (``FULL_COLUMNS``).
    The one-hot columns are collapsed in the first projection, so the ordered
    scans (back-fill, lag) run on a narrow table.
    """
    cols = wide.columns
    blank = lambda c: F.nullif(F.col(c), F.lit(""))  # noqa: E731  N1
    no_key = lambda c: F.nullif(blank(c), F.lit(NO_KEY))  # noqa: E731  N2
    # D3: practice rows have no corr and no block-loop counter
    practice_cols = _lower_match(cols, "both_", "_corr") + _lower_match(cols, "nBlocks", "_thisTrialN")
    df = wide.where(X.any_not_null([blank(c) for c in practice_cols]))
    loc_keys = _lower_match(cols, "both_loc_", "_keys")
    shape_keys = _lower_match(cols, "both_shape_", "_keys")
    task1 = F.when(X.all_null([no_key(c) for c in loc_keys]), F.lit("shape"))    # D5
    task2 = F.when(X.all_null([no_key(c) for c in shape_keys]), F.lit("loc"))
    key_cols = _lower_match(cols, "both_", "_keys")
    rt_cols = _lower_match(cols, "both_", "_rt")
    corr_cols = _lower_match(cols, "both_", "_corr")
    rep_cols = _lower_match(cols, "nBlocks", "_thisRepN")
    trial_n = X.to_long(X.unite([blank(c) for c in _lower_match(cols, "nTrials", "_thisN")]))
    df = df.select(
        F.col(file_key), *[c for c in keys_order if c != file_key], *([segment.alias(SEGMENT)] if segment is not None else []),
        X.to_long(blank("participant")).alias("id"),
        # block-end rows carry the block number but no trial (dropped after the back-fill)
        X.any_not_null([blank(c) for c in ("Cue", "Task", "Block")]).alias("_is_trial"),
        (X.to_int(X.unite([blank(c) for c in rep_cols])) + 1).alias("_blk"),          # D4
        blank("Block").alias("block"),
        blank("Task").alias("trial_type"),
        cued_task(blank("Cue")).alias("task_cued"),                                    # D6
        X.unite([task1, task2]).alias("task_perf"),
        X.unite([no_key(c) for c in key_cols]).alias("resp"),                          # D7
        X.to_double(X.unite([blank(c) for c in rt_cols])).alias("rt"),
        X.to_int(X.unite([F.nullif(blank(c), F.lit(str(NOT_ASKED))) for c in corr_cols])).alias("corr"),
        (trial_n + 1).alias("trialNr"),                                                # D11
        *[(F.lower(blank(n)) if n == "Type" else blank(n)).alias(c) for n, c in STIMULUS_COLUMNS.items() if stimulus],
    )
    df = df.withColumn("countBal", counterbalance("id"))                             # D1
    # one segment for both scans, as an (id, block) group lies inside a file
    if segment is None:
        df = ranged(df, [file_key], list(keys_order), SEGMENT)
    df = ordered_scan(df, [file_key], list(keys_order), fill_up={"blockNr": "_blk"}, segment=F.col(SEGMENT))
    df = df.where(F.col("_is_trial"))
    # D9, D10 before the filters, then F6, F7 and D2
    df = code_switches(df, keys=("id", "blockNr"), order=list(keys_order), segment=F.col(SEGMENT))
    df = keep_scored(df).withColumn("cBal", block_order("countBal"))
    return df.select(*(FULL_COLUMNS if stimulus else TRIAL_COLUMNS))
