"""The registry: names, SQL for what SQL can express, and the flagship query against it."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no tables")
NAMES = ["flagship", "bin_sum_volume", "bin_derivative", "coordination", "cluster_analysis", "assign_color"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, str(SMALL)).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    rows = lambda d: sorted(tuple(round(float(x), 5) for x in r) for r in d[cols].to_numpy())
    for a, b in zip(rows(got), rows(want)):
        assert a == pytest.approx(b, abs=2e-5)
