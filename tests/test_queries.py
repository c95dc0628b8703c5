"""Every registered query of the library against its SQL in DuckDB on the driver's smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from pulsegrid import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else repr(round(v, 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    found = got.collect()
    if name in registry.oracle_sql():
        db = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        cursor = db.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(columns, cursor.fetchall())
