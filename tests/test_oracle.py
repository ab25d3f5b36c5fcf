"""Every registered query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import differences
from fleetstat.plans import registry
from fleetstat.sources.fixtures import TABLES, definitions

SF_DIR = os.environ.get("FLEETSTAT_TEST_SF", "/root/testdata/sf0.001")
REPORTS = {r.key for r in registry.load_all().values()}
QUERIES = {k: q for k, q in entry.queries().items() if k in REPORTS}
ORACLES = {k: q for k, q in entry.oracle_sql().items() if k in REPORTS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, duck):
    assert differences(QUERIES[key](spark, SF_DIR), duck.sql(ORACLES[key])) == []


@pytest.mark.parametrize("relation", sorted(definitions("spark")))
def test_relation(relation, spark, duck):
    from fleetstat.sources.snapshots import Snapshots
    derived = getattr(Snapshots.from_tables(spark, SF_DIR), relation)
    assert differences(derived, duck.sql(definitions("duckdb")[relation])) == []
