"""Every catalogue query against its DuckDB twin; the scan-heavy ones again with other ranges."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE, SF_SMALL
from oracle import compare, duck
from trialstats.plans import catalog
from trialstats.operators.sequence import RANGES_CONF

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()
SEQUENCE_QUERIES = ["switch_type", "trials_from_events", "trials_coded", "fill_up", "row_sum", "pick_one_of_two",
                    "running_switches", "run_lengths", "vsr_decomposed", "coalesce_wide"]


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) >= 90


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(E.queries())
    assert SQL.items() <= E.oracle_sql().items()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "block", "switch_sum", "n", "vsr"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con_small, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con_small.execute(SQL[name]).df()
    assert compare(got, want) is None, compare(got, want)


@pytest.mark.parametrize("name", SEQUENCE_QUERIES)
def test_segmented_scans_match_oracle(spark, name):
    """With few ranges, more rows than by default lie in one."""
    spark.conf.set(RANGES_CONF, "20")
    try:
        got = QUERIES[name](spark, SF_ORACLE).toPandas()
    finally:
        spark.conf.unset(RANGES_CONF)
    want = duck(SF_ORACLE).execute(SQL[name]).df()
    assert compare(got, want) is None, compare(got, want)
