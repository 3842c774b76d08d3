"""Every query of the library against its SQL."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.operators import running
from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(df):
    cell = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (float, int, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(str([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


SERIES = ["alarm_lifecycles", "asof_join", "broken_pairs", "confirmed_levels", "cut_at_errors", "deadband_levels", "high_intervals", "readings_outside_gaps", "zone_time_by_era", "clipped_decay_level", "coverage_share", "debounced_state", "error_episodes", "forward_fill", "hysteresis_state", "merged_intervals", "resettable_total", "six_hour_grid", "time_in_zone", "time_weighted_mean", "uncovered_intervals", "view_then_purchase", "zone_segments"]


@pytest.mark.parametrize("name", SERIES)
def test_hot_series_are_spread_with_the_same_rows(spark, con, name, monkeypatch):
    """As above, but every series counts as too long for one task."""
    monkeypatch.setattr(running, "LONGEST", 0)
    monkeypatch.setattr(running.bucket_for, "__defaults__", (0,))
    got = catalogue.QUERIES[name](spark, SF)
    assert rows(got.toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name, exchanges", [("debounced_state", 1), ("zone_segments", 2), ("clipped_decay_level", 1), ("resettable_total", 2), ("hysteresis_state", 1), ("uncovered_intervals", 4)])
def test_plans_of_series_stay_linear(spark, name, exchanges):
    """Exchanges and scans as planned, before any reuse."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= exchanges and plan.count("Scan parquet") <= 2, plan


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["millrace/llm"], ["corpus_pipeline.py"], ["millrace/llm", "corpus_pipeline.py"]])
def test_entry_point_without_the_training_data_part(tmp_path, gone):
    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root / "millrace", copy / "millrace", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / f).exists():
            shutil.copy(root / f, copy / f)
    for g in gone:
        shutil.rmtree(copy / g, ignore_errors=True)
        (copy / g).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1_') for q in e.queries()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(copy)}  # the copy, not the repository
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, numbered, pipeline = out.stdout.split()
    assert int(n) >= len(catalogue.QUERIES) and int(sql) >= len(catalogue.ORACLE_SQL)
    assert pipeline == "False" and numbered == str((copy / "millrace" / "llm").exists())
