"""Rule tables: first rule wins, missing texts, references to coded columns, faulty tables; the pilots 2-3 rules row by row."""

import pytest

from trialstats.plans.coding_rules import PILOT_2, RuleTable, code, trials_pilot2
from trialstats.plans.trials import FULL_COLUMNS, code_trials, collapsed_loops

COLS = [f"both_{t}_cb{cb}_{f}" for t in ("shape", "loc") for cb in (1, 2) for f in ("keys", "rt", "corr")]


def _logs(spark, rows):
    schema = "id long, ts long, event_id long, " + ", ".join(f"{c} string" for c in COLS)
    full = [(r.pop("id", 1), i, i, *[r.get(c) for c in COLS]) for i, r in enumerate(dict(x) for x in rows)]
    return spark.createDataFrame(full, schema)


def _shape(cb, key="m", rt="0.5", corr="1"):
    return {f"both_shape_cb{cb}_keys": key, f"both_shape_cb{cb}_rt": rt, f"both_shape_cb{cb}_corr": corr}


def _loc(cb, key="x", rt="0.4", corr="0"):
    return {f"both_loc_cb{cb}_keys": key, f"both_loc_cb{cb}_rt": rt, f"both_loc_cb{cb}_corr": corr}


def test_pilot2_rules(spark):
    rows = [_shape(1), _shape(2), _loc(1), _loc(2), {}, {**_loc(1), **_shape(1)}, {**_shape(1), **_shape(2)}, {**_loc(1), "both_shape_cb2_keys": ""}]
    got = [(r["task_perf"], r["resp"], r["corr"], r["rt"]) for r in code(_logs(spark, rows), PILOT_2).orderBy("event_id").collect()]
    assert got == [("shape", "m", "1", 0.5), ("shape", "m", "1", 0.5), ("loc", "x", "0", 0.4), ("loc", "x", "0", 0.4),
                   ("shape", None, None, None),  # loc is tested first, so no response at all counts as shape
                   ("unknownTask", "unknownResp", "unknownCorr", None), ("shape", "unknownResp", "unknownCorr", None), ("loc", "x", "0", 0.4)]


def test_pilot2_switches_cross_blocks_and_precede_the_filter(spark):
    rows = [_shape(1), _loc(1), {**_loc(1), "both_loc_cb1_corr": "999"}, _loc(1), {**_loc(1), **_shape(1)}, _shape(1)]
    got = [(r["event_id"], r["switch_type"], r["switch"]) for r in trials_pilot2(_logs(spark, rows)).orderBy("event_id").collect()]
    assert got == [(0, "unknownSwitch", None), (1, "switch_loc", 1.0), (3, "stay_loc", 0.0), (4, "unknownSwitch", None), (5, "unknownSwitch", None)]


def test_tables_are_data(spark):
    df = spark.createDataFrame([("a", "none", 1), (None, "q", 2), ("", "none", 3)], "u string, v string, n int")
    size = RuleTable("size", [([("is", "n", 1)], ("text", "one"))], ("text", "more"))
    both = RuleTable("both", [([("missing", "u", "v"), ("is", "size", "more")], ("text", "nothing")), ([("missing", "u")], ("column", "v"))],
                     ("column", "u"), missing=("", "none"))
    assert [(r["size"], r["both"]) for r in code(df, [size, both]).orderBy("n").collect()] == [("one", "a"), ("more", "q"), ("more", "nothing")]
    assert code(df, [RuleTable("z", [], None, "int")]).dtypes[-1] == ("z", "int")
    for bad in (RuleTable("b", [([("like", "u", "a")], None)]), RuleTable("b", [([("is", "n", 1)], ("regex", "u"))])):
        with pytest.raises(ValueError):
            bad.expression()


def test_full_columns_and_loops(spark):
    from trialstats.plans.trials import wide_logs_from_events
    wide = wide_logs_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(60))
    assert code_trials(wide, stimulus=True).columns == FULL_COLUMNS
    loops = collapsed_loops(wide, ["event_id"])
    assert loops.columns[1:] == [f"n{x}_{f}" for x in ("Blocks", "Trials") for f in ("thisRepN", "thisTrialN", "thisN", "thisIndex")]
    assert all(t == "int" for _, t in loops.dtypes[1:])
