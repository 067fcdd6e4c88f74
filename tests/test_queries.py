"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registry
from workload.oracles import SQL
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "lineitem orders customer".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def _sorted(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = _sorted(result.fetchall(), names)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == expected
    assert expected


def test_entry_is_lazy_and_has_rows(spark):
    spark.sparkContext.setJobGroup("entry", "entry")
    try:
        df = registry.entry(spark)
        tracker = spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("entry") for s in tracker.getJobInfo(j).stageIds]
        # Only the schemas of the input files are read.
        assert all(tracker.getStageInfo(s).name.startswith("parquet at") for s in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.count() == 21
