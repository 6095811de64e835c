"""The driver contract, and a spread of registered queries against their SQL (``check.py`` compares all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tidegrid.queries import load

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "a02_csv_load", "b09_first_per_timestamp", "b13_native_interval", "c03_role_resample", "c06_carpet_median", "d02_two_step_join", "d07_near_gap_boundary",
    "d11_previous_period", "e02_missing_periods", "e13_boundary_rows", "e15_removed_episodes", "f06_fill_summary", "g09_combined_flags", "h06_startup_shutdown",
    "h10_control_features", "i01_describe", "i18_load_duration", "i20_welch_t_test", "j02_spearman", "j10_optimal_lag", "k15_mad_filter", "l10_persistence",
    "l17_events", "l22_result_table", "m04_linear_regression", "flagship_gap_safe_fill",
)

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # of the library's own queries, model fits and the raw-to-clean chain are checked for rows only
    own = load()
    assert len(set(own.QUERIES) - set(own.ORACLES)) <= 8


@needs_data
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"event_type", "ts", "temp", "temp_is_interpolated", "gap_start"} == set(df.columns)
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert check.compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"
