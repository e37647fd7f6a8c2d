"""Invariants of SURVEY §5.3 and the documented reference defects (§2.16)."""

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from trialstats.operators import reshape as R
from trialstats.plans import metrics as M
from trialstats.plans.catalog import trials


def test_shares_sum_to_one(spark):
    t = trials(spark, SF_ORACLE)
    w = M.switch_stay_per_id(t)
    assert w.where(F.abs(F.col("switch_prop") + F.col("stay_prop") - 1) > 1e-12).count() == 0
    assert M.rep_bias_overall(t).select("checkSum").distinct().first()[0] == 1.0


def test_vsr_identity_and_lost_easy_counts(spark):
    """§2.16 #9: with the reference's nested join, 21 of 299 (id, block) groups lose their easy count."""
    t = trials(spark, SF_ORACLE)
    faithful = M.vsr_decomposed(t).toPandas().set_index(["id", "block"]).sort_index()
    intended = M.vsr_decomposed(t, keep_lonely_easy=True).toPandas().set_index(["id", "block"]).sort_index()
    assert len(faithful) == 299
    assert int((faithful["switch_easy"] != intended["switch_easy"]).sum()) == 21
    assert ((intended["vsr_easy"] + intended["vsr_diff"]).round(3) == intended["vsr"]).all()
    check = M.check_vsr(t).toPandas()
    assert int((check["checkVsr"] == 0).sum()) == 21


def test_run_lengths_sum_to_trials(spark):
    t = trials(spark, SF_ORACLE)
    runs = M.run_lengths(t).agg(F.sum("n")).first()[0]
    assert runs == t.where(M.known_switch() & M.free()).count()


def test_pivot_round_trip(spark):
    t = trials(spark, SF_ORACLE)
    counts = t.groupBy("id", "block").count()
    wide = R.pivot_wider(counts, ["id"], "block", "count", ["mixed", "freeOnly"])
    back = R.pivot_longer(wide, ["id"], ["mixed", "freeOnly"], "block", "count").dropna()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.select("id", "block", "count").collect()))


def test_result_does_not_depend_on_partitioning(spark):
    ev = spark.read.parquet(f"{SF_ORACLE}/events.parquet")
    from trialstats.plans.trials import trials_from_events
    a = M.vsr(trials_from_events(ev)).collect()
    b = M.vsr(trials_from_events(ev.repartition(13, "event_type"))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_report_writes_tables_from_one_materialized_trials(spark, tmp_path):
    from trialstats.plans.report import run_report
    from trialstats.plans.catalog import trials as load_trials
    paths = run_report(spark, load_trials(spark, SF_ORACLE), str(tmp_path / "report"), only=["vsr", "rt_density"])
    assert spark.read.parquet(paths["vsr"]).count() == 299
    assert spark.read.parquet(paths["rt_density"]).count() == 512


def test_assert_same_count(spark):
    import pytest
    from trialstats.operators.joins import assert_same_count
    a = spark.range(3)
    assert_same_count(a, spark.range(3))
    with pytest.raises(AssertionError):
        assert_same_count(a, spark.range(4))
