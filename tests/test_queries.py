"""Named queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

CHECKED = [
    "readings_clean", "load_furnace_log", "load_milling_logs", "timestamp_fallback", "sort_and_renumber",
    "numeric_coercion", "context_join", "state_share", "window_validation", "dataset_validation",
    "spectral_features", "window_analysis", "state_segments", "cycle_position", "cycle_summary",
    "header_rules", "registry_load", "row_range_files", "result_runs", "window_context", "label_agreement", "job_clusters",
    "job_cluster_summary", "job_names", "labelled_readings", "lookback_moments", "ml_candidates", "ml_prediction_check", "ml_range", "short_logs",
    "lookback_windows", "confusion_matrix", "class_report", "multitask_loss", "streaming_windows",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry(spark).count() == 12


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf_dir, con, name):
    got = queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    assert compare(got, con.execute(oracle_sql()[name]).df()) == "ok"


def test_every_window_has_its_context(spark, sf_dir):
    windows = queries()["sliding_windows"](spark, sf_dir).select("machine", "window_index")
    context = queries()["window_context"](spark, sf_dir)
    assert context.select("machine", "window_index").distinct().count() == windows.count()
    assert windows.join(context, ["machine", "window_index"], "left_anti").isEmpty()
