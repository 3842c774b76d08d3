"""The streamed queries on events that lie in many files."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import SF, rows

from millrace.plans import catalogue


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """events of SF as 20 files that are not in order of time."""
    sf = tmp_path_factory.mktemp("many")
    spark.read.parquet(f"{SF}/events.parquet").repartition(20, F.xxhash64("event_id")).write.parquet(f"{sf}/events.parquet")
    return str(sf)


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    assert len(want) > 0 and rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(want)


def test_last_reading_of_many_files(spark, many):
    same_as_sql(spark, many, "streamed_last_reading")


def test_last_reading_of_no_events(spark, many, tmp_path):
    spark.read.parquet(f"{many}/events.parquet").limit(0).write.parquet(f"{tmp_path}/rows/events.parquet")
    got = catalogue.streamed_last_reading(spark, f"{tmp_path}/rows")
    assert got.count() == 0
    (tmp_path / "none" / "events.parquet").mkdir(parents=True)
    none = catalogue.streamed_last_reading(spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.dtypes == got.dtypes


def test_hourly_windows_of_shuffled_files(spark, many):
    same_as_sql(spark, many, "streamed_hourly_windows")
