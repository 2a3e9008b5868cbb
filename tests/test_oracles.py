"""Every query with a SQL twin gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from emberlog.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


#: Folds and models that SQL can't say; tests/test_windows.py holds them against plain loops.
WITHOUT_SQL = {"greedy_windows", "windowed_brute_chains", "windowed_spray_chains", "isolation_forest_scores"}


def test_only_these_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL
